"""URL filtering by a character language-model ratio (operator 4).

Rules of host and path judge the urls that they fit. Two Markov models of characters, of
order 0 to ``ORDER`` and blended by Witten and Bell's method, learn what rules accept and
reject; any other url is judged by the difference of the two models' log-likelihoods per
character, against a threshold that gives both classes of a calibration part the same
share of errors.

The models are counts over all distinct urls that rules judge, but one in ``CALIBRATE``, on all of which the threshold is
found; copies of a url change nothing. Counts are rows of runs of characters, which are joined with
the runs of the urls to judge, so neither the driver nor a task holds a model; no html is read. (``fit`` is the same
method in memory, on a bounded sample, for tables that are small.)

Defined results: a null url, or one without ``://``, has empty host and path and no rule;
a null or empty url is blocked; without urls of both classes the others are allowed;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Cuts, lean, small_batches
from gleaner.operators.order import numbered, running

#: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
#: Distinct urls of each class that ``fit`` learns from at most, and characters of all of them.
PER_CLASS, CHARS = 4000, 400_000
#: One in so many of the sample's urls calibrates the threshold instead of training.
CALIBRATE = 4


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where there is no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(urls: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(key, url, host, path, rule, judged): the longest rule that fits, and its verdict; both null where none does."""
    host, path = parts(F.col(url))
    rows = urls.select(F.col(key).alias(key), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule = judged = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule, judged = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(judged)
    return rows.withColumn("rule", rule).withColumn("judged", judged)


class Markov:
    """Counts of each context's next characters, for contexts of up to ``ORDER`` characters."""

    def __init__(self, texts: list[str]):
        counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for t in texts:
            t = "\x02" * ORDER + t + "\x03"
            for i in range(ORDER, len(t)):
                for n in range(ORDER + 1):
                    counts[t[i - n : i]][t[i]] += 1
        self.next = {c: dict(x) for c, x in counts.items()}
        self.total = {c: sum(x.values()) for c, x in self.next.items()}

    def chance(self, context: str, char: str, alphabet: int) -> float:
        p = 1 / alphabet
        for n in range(len(context) + 1):
            after = self.next.get(c := context[len(context) - n :])
            if after is None:
                break
            p = (after.get(char, 0) + len(after) * p) / (self.total[c] + len(after))
        return p


class Ratio:
    """How much likelier a url is among accepted ones, in nats per character."""

    def __init__(self, accepted: list[str], rejected: list[str]):
        self.models = Markov(accepted), Markov(rejected)
        self.alphabet = len(set("".join(accepted + rejected))) + 2
        self.threshold = 0.0
        self.known: dict[str, float] = {}

    def score(self, url: str) -> float:
        t = "\x02" * ORDER + url + "\x03"
        total = 0.0
        for i in range(ORDER, len(t)):
            gram = t[i - ORDER : i + 1]
            got = self.known.get(gram)
            if got is None:
                a, b = (m.chance(gram[:-1], gram[-1], self.alphabet) for m in self.models)
                if len(self.known) >= 200_000:
                    self.known.clear()
                got = self.known[gram] = math.log(a / b)
            total += got
        return total / (len(url) + 1)


def training_sample(rows: DataFrame) -> dict[str, list[str]]:
    """Verdict -> its distinct urls with the smallest hashes, ``PER_CLASS`` at most, up to ``CHARS`` characters of all.

    A url that is longer than that alone is passed over.
    """
    labelled = rows.where("judged is not null").select("judged", "url").where(F.length("url").between(1, CHARS))
    distinct = {r[0]: r[1] for r in labelled.groupBy("judged").agg(F.approx_count_distinct("url")).collect()}
    place = F.pmod(F.xxhash64(F.lit("urls"), F.col("url")), F.lit(1 << 30)) / float(1 << 30)
    out = {}
    for verdict, n in distinct.items():
        # twice as many as wanted, in the mean, leave enough after an estimate that is off
        some = labelled.where((F.col("judged") == verdict) & (place < min(1.0, 2 * PER_CLASS / max(n, 1)))).select("url").distinct()
        # a row for each of the sample
        first = some.select("url", place.alias("place"), F.length("url").alias("n")).orderBy("place", "url").limit(PER_CLASS)
        fits = F.sum("n").over(Window.orderBy("place", "url").rowsBetween(Window.unboundedPreceding, 0)) <= CHARS
        out[verdict] = sorted(r[0] for r in first.withColumn("fits", fits).where("fits").select("url").collect())
    return out


def fit(rows: DataFrame) -> Ratio | None:
    """``rows`` as ``ruled`` gives them; None where a class has no urls."""
    by = training_sample(rows)
    if not by.get("allow") or not by.get("block"):
        return None
    return fitted(by["allow"], by["block"])


def fitted(allowed: list[str], blocked: list[str]) -> Ratio:
    """Two models of three quarters of the urls, and the threshold at which the others have equal shares of errors."""
    few = lambda v: len(v) < CALIBRATE
    train = [[u for i, u in enumerate(v) if i % CALIBRATE or few(v)] for v in (allowed, blocked)]
    ratio = Ratio(*train)
    good, bad = (np.sort([ratio.score(u) for i, u in enumerate(v) if not i % CALIBRATE or few(v)]) for v in (allowed, blocked))
    at = np.unique(np.concatenate([good, bad]))
    lost, passed = np.searchsorted(good, at) / len(good), 1 - np.searchsorted(bad, at) / len(bad)
    ratio.threshold = float(at[np.abs(lost - passed).argmin()])
    ratio.known.clear()
    return ratio


#: Log ratios of a run of characters are summed as integers of this unit: the same url has the same score in any order.
UNIT = float(1 << 36)


def runs(url: str) -> list[str]:
    """Each character of a url with the ``ORDER`` before it."""
    t = "\x02" * ORDER + url + "\x03"
    return [t[i - ORDER : i + 1] for i in range(ORDER, len(t))]


def _counted(batches):
    """(judged, url) -> (run, a, b): how often accepted and rejected urls of the batch have it."""
    for batch in batches:
        counts = Counter((r, v == "allow") for v, u in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in runs(u))
        found = sorted({r for r, _ in counts})
        yield pa.record_batch([pa.array(found, pa.string()), *(pa.array([counts[r, v] for r in found], pa.int64()) for v in (True, False))], names=["run", "a", "b"])


def _characters(batches):
    for batch in batches:
        yield pa.record_batch([pa.array(sorted(set().union(*batch.column(0).to_pylist())), pa.string())], names=["c"])


def _pieces(batches):
    """(id, url) -> (id, run, n)."""
    for batch in batches:
        for i, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = Counter(runs(url))
            yield pa.record_batch([pa.array([i] * len(counts), pa.int64()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["id", "run", "n"])


def ratios(wanted: DataFrame, counts: DataFrame, alphabet: int) -> DataFrame:
    """(run) -> (run, ratio): ``Ratio``'s log ratio of its last character after the others, in ``UNIT``; ``counts`` has run, a and b."""
    rows = wanted.withColumns({"pa": F.lit(1 / alphabet), "pb": F.lit(1 / alphabet)})
    for n in range(ORDER + 1):
        cells = counts.groupBy(F.substring("run", ORDER - n + 1, n + 1).alias("cell")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        after = cells.groupBy(F.substring("cell", 1, n).alias("context")).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count_if(F.col("a") > 0).alias("ka"), F.count_if(F.col("b") > 0).alias("kb"))
        rows = rows.withColumns({"cell": F.substring("run", ORDER - n + 1, n + 1), "context": F.substring("run", ORDER - n + 1, n)})
        rows = rows.join(cells, "cell", "left").join(after, "context", "left")
        chance = lambda c: F.when(F.col(f"t{c}") > 0, (F.coalesce(c, F.lit(0)) + F.col(f"k{c}") * F.col(f"p{c}")) / (F.col(f"t{c}") + F.col(f"k{c}"))).otherwise(F.col(f"p{c}"))  # noqa: B023, E731
        rows = rows.select("run", chance("a").alias("pa"), chance("b").alias("pb"))
    return rows.select("run", F.round(F.log(F.col("pa") / F.col("pb")) * UNIT).cast("long").alias("ratio"))


def scores(rows: DataFrame) -> tuple[DataFrame, float] | None:
    """``rows`` as ``ruled`` gives them -> (url, score) of all that no rule judges, and the threshold; None where a class has no urls."""
    cuts = Cuts(rows.sparkSession, "urls")
    given = rows.where(F.length("url") > 0)
    labelled = cuts.write(given.where("judged is not null").select("judged", "url").distinct())
    sizes = {r.judged: r["count"] for r in labelled.groupBy("judged").count().collect()}  # two rows
    if not sizes.get("allow") or not sizes.get("block"):
        return None
    few = F.col("judged").isin([v for v, n in sizes.items() if n < CALIBRATE])
    told = cuts.write(numbered(labelled, ["url"], "i", 0, cuts, by=["judged"]).withColumn("tests", F.col("i") % CALIBRATE == 0))
    train = told.where(~F.col("tests") | few).select("judged", "url")
    counts = cuts.write(train.mapInArrow(lean(_counted), "run string, a long, b long").groupBy("run").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    alphabet = train.select("url").mapInArrow(lean(_characters), "c string").distinct().count() + 2
    tests = told.where(F.col("tests") | few).select("judged", "url")
    judge = given.where("judged is null").select("url").unionByName(tests.select("url")).distinct()
    judge = cuts.write(judge.withColumn("id", F.monotonically_increasing_id()))
    pieces = cuts.write(judge.select("id", "url").mapInArrow(lean(_pieces), "id long, run string, n long"))
    known = cuts.write(ratios(pieces.select("run").distinct(), counts, alphabet))
    sums = pieces.join(known, "run").groupBy("id").agg(F.sum(F.col("n") * F.col("ratio")).alias("total"))
    found = cuts.write(judge.join(sums, "id").select("url", (F.col("total") / UNIT / (F.length("url") + 1)).alias("score")))
    cuts.drop(pieces)
    held = lambda v: sizes[v] if sizes[v] < CALIBRATE else -(-sizes[v] // CALIBRATE)
    ties = tests.join(found, "url").groupBy("score").agg(F.count_if(F.col("judged") == "allow").alias("good"), F.count_if(F.col("judged") == "block").alias("bad"))
    ends = running(ties, ["score"], {"g": "good", "b": "bad"}, cuts).withColumns({"ng": F.lit(held("allow")), "nb": F.lit(held("block"))})
    unfair = F.abs((F.col("g") - F.col("good")) / F.col("ng") - (1 - (F.col("b") - F.col("bad")) / F.col("nb")))
    return found, ends.orderBy(unfair, "score").first().score


def judged(urls: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Per row: key, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule judges)."""
    small_batches(urls.sparkSession)
    rows = ruled(urls, key, url, rules)
    learned = scores(rows)
    if learned is None:
        rows, least = rows.withColumn("score", F.lit(None).cast("double")), 0.0
    else:
        found, least = learned
        rows = rows.join(found, "url", "left").withColumn("score", F.when(F.col("judged").isNull(), F.col("score")))
    method = F.when(F.coalesce(F.length("url"), F.lit(0)) == 0, "block").when(F.col("score") < least, "block").otherwise("allow")
    return rows.select(key, "host", "path", "rule", F.coalesce("judged", method).alias("verdict"), "score")
