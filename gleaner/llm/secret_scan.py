"""Secret scans with corpus-wide ownership frequency (operator 8), native expressions only.

Three base patterns give spans of likely secrets; a fourth finds long mixed tokens that no
base pattern names. The hash of each found value is counted over distinct repositories and
owners. A value that several owners hold, or that is in many repositories, is a widely
copied example; a value of one owner and few repositories that looks live is a credential
of that owner, and a long mixed token counts as a secret just then. A repository that is
copied to other owners counts once. Base spans stay whatever their values' owners are.

Offsets come without a UDF: the text split at a pattern and the pattern's matches alternate,
so their lengths add up to the places. What is found is written without texts; counting
and joining read that. Values are counted by partial sums, so a value with a third of all
finds is one row of each task; the join on values is one that can be split. Joins are by merge: the driver builds no table of finds.

Defined results: a null text counts as empty; a null owner or repository is an owner or
repository of its own; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.arrays import let, placed, running
from gleaner.llm.common import Cuts, marked_rows, told_apart, unused

#: Kinds in listed order: pattern, group with the secret's value, least length of that group.
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: A run of token characters, whole; what of it counts is for ``mixed_token``.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: A value that so many distinct owners hold, or that is in so many distinct repositories, is a copied example.
COPIED, SPREAD = 2, 16
#: A value with fewer distinct characters does not look live.
LIVELY = 8


def found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, kind, value): leftmost matches that do not overlap, short ones dropped.

    Offsets count code points from 0, ends are exclusive.
    """
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m
    named = F.transform(placed(text, pattern), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), value(x["all"]).alias("value")))
    spans = F.filter(named, lambda x: F.length(x["value"]) >= least)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))


def mixed_token(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def _place(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k, *_ in BASE), F.lit("owned")), kind).cast("int")


def scan(docs: DataFrame, cuts: Cuts, key: str, owner: str, repository: str, text: str) -> DataFrame:
    """A written row per document: row, id, owner, repository and its finds, base and other, with hashes for values."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kind = "array<struct<start:int,end:int,place:int,kind:string,hash:string,live:boolean>>"

    def hashed(spans: Column) -> Column:
        live = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= LIVELY
        return F.transform(spans, lambda x: F.struct(x["start"], x["end"], _place(x["kind"]).alias("place"), x["kind"], F.substring(F.sha2(x["value"], 256), 1, 32).alias("hash"), live(x["value"]).alias("live"))).cast(kind)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), whole.alias("t"))
    rows = rows.select("row", "id", "owner", "repository", *(hashed(found(F.col("t"), *b)).alias(b[0]) for b in BASE), hashed(F.filter(found(F.col("t"), "owned", TOKEN, 0, 20), lambda x: mixed_token(x["value"]))).alias("tokens"))
    base = F.sort_array(F.concat(*(F.col(b[0]) for b in BASE)))
    return cuts.write(rows.withColumn("base", base).select("row", "id", "owner", "repository", "base", outside(F.col("tokens"), F.col("base")).alias("more")))


#: Behind any text.
BEHIND = 1 << 30


def outside(tokens: Column, base: Column) -> Column:
    """The tokens that meet no base span: none before reaches into them, and the next begins behind them."""

    def apart(all_: Column) -> Column:
        far = running(F.transform(all_, lambda x: F.when(x["base"], x["span"]["end"]).otherwise(0)), F.lit(0), F.greatest)
        near = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x["base"], x["span"]["start"]).otherwise(BEHIND))), F.lit(BEHIND), F.least))
        zipped = F.arrays_zip(all_.alias("x"), far.alias("far"), near.alias("near"))
        free = F.filter(zipped, lambda z: ~z["x"]["base"] & (z["far"] <= z["x"]["span"]["start"]) & (z["near"] >= z["x"]["span"]["end"]))
        return F.transform(free, lambda z: z["x"]["span"])

    told = lambda spans, is_base: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(is_base).alias("base"), x.alias("span")))
    both = F.sort_array(F.concat(told(base, True), told(tokens, False)))
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(both, apart))


def ownership(finds: DataFrame) -> DataFrame:
    """(hash, owner, repository) -> hash, ``owners``, ``repositories``: distinct ones.

    A repository that several owners have is a copy, and counts for one of them.
    """
    each = finds.groupBy("hash", "repository").agg(F.min("owner").alias("owner"))
    owned = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owned.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def secrets(docs: DataFrame, key: str = "doc_id", owner: str = "source", repository: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``base`` and ``spans`` (arrays of start, end, kind, owners, repositories, live).

    ``spans`` has the base spans and the owner-specific long tokens, by start and kind.
    """
    cuts = Cuts(docs.sparkSession, "secrets")
    rows = scan(docs, cuts, key, owner, repository, text)
    none = (F.size("base") == 0) & (F.size("more") == 0)
    shape = "array<struct<start:int,end:int,place:int,kind:string,owners:long,repositories:long,live:boolean>>"
    empty = rows.where(none).select(F.col("id").alias(key), F.array().cast(shape).alias("base"), F.array().cast(shape).alias("spans"))
    finds = rows.where(~none).select("row", "id", "owner", "repository", F.explode(F.concat("base", "more")).alias("f")).select("row", "id", "owner", "repository", "f.*")
    judged = finds.join(ownership(finds).hint("merge"), "hash").withColumn("live", F.col("live") & (F.col("owners") < COPIED) & (F.col("repositories") < SPREAD))
    kept = judged.where((F.col("kind") != "owned") | F.col("live"))
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "place", "kind", "owners", "repositories", "live"))).alias("spans"))
    # by start and then kind: no two spans of a kind start together
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["place"] - b["place"]))
    held = rows.where(~none).join(spans.hint("merge"), "row", "left").withColumn("spans", F.coalesce(ordered, F.array().cast(shape)))
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    return held.select(F.col("id").alias(key), base.alias("base"), F.col("spans").cast(shape)).unionByName(empty)


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_text(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with their repository: equal texts are one."""
    return docs.withColumn(name, F.md5(F.coalesce(F.col(text), F.lit(""))))


def digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "source", "text")
    got = secrets(by_text(docs, "repository"), repository="repository")

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select(
        "doc_id",
        *(n(kind) for kind, *_ in BASE),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: x["owners"] >= COPIED)).cast("long").alias("n_copied"),
    )


#: Characters of a run.
RUN = 1024


def blanked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping ones, as a mark; spans are ordered by start."""

    def part(runs: Column, a: Column, b: Column) -> Column:
        """Characters a to b, from the runs that hold them: a text is not walked from its start for each."""
        first = F.floor(a / RUN).cast("int")
        held = F.slice(runs, first + 1, F.greatest(F.lit(0), F.floor((b - 1) / RUN).cast("int") - first + 1))
        return F.array_join(held, "").substr(a % RUN + 1, F.greatest(F.lit(0), b - a))

    def cut(runs: Column, far: Column) -> Column:
        # a span that begins behind all before it ends a piece of text
        zipped = F.arrays_zip(spans.alias("x"), far.alias("far"))
        pieces = F.transform(zipped, lambda z: F.when(z["x"]["start"] >= z["far"], F.concat(part(runs, z["far"], z["x"]["start"]), F.lit(mark))).otherwise(F.lit("")))
        last = F.greatest(F.element_at(far, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(pieces, ""), text.substr(last + 1, F.length(text) - last))

    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0))
    far = running(F.transform(spans, lambda x: x["end"]), F.lit(0), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(let(runs, lambda r: let(far, lambda f: cut(r, f))))



def without_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str | None = "n_chars", owner: str = "source", repository: str | None = None) -> DataFrame:
    """``docs`` with every span blanked and ``count`` set to the new length; rows stay.

    Rows are told apart by their places, so rows with a null or repeated key get their own
    spans; only rows that may have spans are shuffled. Without a ``repository`` column equal
    texts are one repository.
    """
    own, found_, held, hit = unused(docs, "secret_row", "secret_spans", "secret_repository", "map_hit")
    told, columns = told_apart(docs, own, Cuts(docs.sparkSession, "blanked")), docs.columns
    named = told.select(own, text, owner, *({repository} - {text, owner} if repository else ()))
    named = named if repository else by_text(named, held, text)
    hits = secrets(named, key=own, text=text, owner=owner, repository=repository or held).where(F.size("spans") > 0)
    hits = hits.select(F.col(own), F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(found_))
    hits = Cuts(docs.sparkSession, "hits").write(hits)
    marked = marked_rows(told, own, hits, hit)
    got = marked.where(F.col(hit)).join(hits.hint("merge"), own, "left")
    spotted = F.col(found_).isNotNull()
    got = got.withColumn(text, F.when(spotted, blanked(F.col(text), F.col(found_))).otherwise(F.col(text)))
    if count and count in columns:
        got = got.withColumn(count, F.when(spotted, F.length(text).cast(docs.schema[count].dataType)).otherwise(F.col(count)))
    return marked.where(~F.col(hit)).select(*columns).unionByName(got.select(*columns))
