"""Scoring a corpus and keeping the best; id handling; memoised queries."""

from __future__ import annotations

import hashlib
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Params
from gleaner.operators import blocks, dense
from gleaner.operators.model import Model, counts_by_subtraction, counts_dated, train, written_ids
from gleaner.operators.order import numbered, running
from gleaner.session import Cuts

def between(docs: DataFrame, mindate: int | None, maxdate: int | None) -> DataFrame:
    """Both bounds count; null is no bound. The filter reaches the scan."""
    if mindate is not None:
        docs = docs.where(F.col("date_key") >= mindate)
    if maxdate is not None:
        docs = docs.where(F.col("date_key") <= maxdate)
    return docs


def without(docs: DataFrame, exclude: DataFrame | None) -> DataFrame:
    return docs if exclude is None else docs.join(exclude.select("pmid").distinct(), "pmid", "left_anti")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(pmid, score): base, prior and the weights of a document's features.

    Features of weight 0 are left out; a document without any keeps its row. Weights that are few enough go to every
    task, and a document is summed where it is; of others, a block of documents gets what its features weigh.
    """
    useful = Cuts(docs.sparkSession, "weights").write(model.weights.where("score <> 0").select("fid", F.col("score").alias("weight")))
    if (weights := dense.table(useful, ["weight"])) is not None:
        sums = dense.summed(docs, weights, ["own"])
    else:
        sums = blocks.summed(docs, useful.withColumnRenamed("weight", "own"), ["own"])
    return sums.crossJoin(F.broadcast(model.scalars.select("base", "prior"))).select("pmid", (F.col("own") + F.col("base") + F.col("prior")).alias("score"))


def ranked(scores: DataFrame, limit: int | None = None, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """(rank, pmid, score): best first, ties to the larger id; scores are rounded before they are ordered.

    The window over the best sees ``limit`` rows at most; without a limit, rows are numbered by range.
    """
    rows, order = passing(scores, threshold, digits), (F.desc("score"), F.desc("pmid"))
    if limit is None:
        return numbered(rows, order, "rank").select("rank", "pmid", "score")
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "pmid", "score")


def passing(scores: DataFrame, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """(pmid, score): rounded scores of the threshold at least."""
    rows = scores.select("pmid", F.round("score", digits).alias("score"))
    return rows if threshold is None else rows.where(F.col("score") >= threshold)


def retrieve(docs: DataFrame, model: Model, params: Params = Params(), exclude: DataFrame | None = None) -> DataFrame:
    """The best documents of the dates that are not excluded."""
    return ranked(scored(docs, model, params, exclude), params.limit, params.threshold)


def scored(docs: DataFrame, model: Model, params: Params = Params(), exclude: DataFrame | None = None) -> DataFrame:
    """(pmid, score) of the documents of the dates that are not excluded."""
    return score(without(between(docs, params.mindate, params.maxdate), exclude), model)


def learn(docs: DataFrame, vocab: DataFrame, positives: DataFrame, params: Params = Params(), train_exclude: DataFrame | None = None) -> Model:
    """Counts and weights; with dates, the background has them too."""
    low, high = params.training_dates
    if low is None and high is None and train_exclude is None:
        counts, totals = counts_by_subtraction(docs, vocab, positives)
    else:
        counts, totals = counts_dated(docs, vocab, positives, low, high, train_exclude)
    return train(counts, totals, params)


def query(docs: DataFrame, vocab: DataFrame, positives: DataFrame, params: Params = Params(), exclude_positives: bool = True) -> tuple[DataFrame, DataFrame, Model]:
    """(ranked results, scored inputs, model). Inputs are not ranked: ``ranked`` does that where it is wanted."""
    ids = written_ids(positives, Cuts(docs.sparkSession, "ids"))
    model = learn(docs, vocab, ids, params)
    results = retrieve(docs, model, params, ids if exclude_positives else None)
    inputs = passing(score(docs.join(ids, "pmid", "left_semi"), model))
    return results, inputs, model


def ids_key(ids: DataFrame) -> str:
    """A digest of a set of ids, whatever their order and partitions: their number, and the sums of two hashes."""
    h = [F.sum(F.xxhash64(F.lit(k), F.col("pmid")).cast("decimal(38,0)")) for k in (1, 2)]
    return "|".join(str(x) for x in ids.select("pmid").distinct().agg(F.count("*"), *h).first())


def query_key(params: Params, *more: str) -> str:
    """Names a query's stored results: the same for the same parameters and whatever else counts, such as ``ids_key`` of the positives."""
    said = repr(sorted(asdict(params).items())) + "|".join(more)
    return hashlib.sha256(said.encode()).hexdigest()[:24]


def remembered(make, path: str, spark) -> DataFrame:
    """A table read from ``path`` if it was completed there, else made and written first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def enriched(ranked_rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Ranked rows with their articles' fields."""
    return ranked_rows.join(articles, "pmid").orderBy("rank")


def id_status(ids: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(pmid, status): broken if not in ``include``, else excluded if in ``exclude``, else ok. Repeats stay."""
    rows = ids.select("pmid")
    inside = F.lit(True)
    if include is not None:
        rows = rows.join(include.select("pmid", F.lit(True).alias("_in")).distinct(), "pmid", "left")
        inside = F.col("_in").isNotNull()
    outside = F.lit(False)
    if exclude is not None:
        rows = rows.join(exclude.select("pmid", F.lit(True).alias("_out")).distinct(), "pmid", "left")
        outside = F.col("_out").isNotNull()
    return rows.select("pmid", F.when(~inside, "broken").when(outside, "excluded").otherwise("ok").alias("status"))


class NoValidIds(ValueError):
    """No id of a query's input is in the index; ``broken`` is the table (pmid) of all of them."""

    def __init__(self, broken: DataFrame):
        super().__init__("no valid ids")
        self.broken = broken


def valid_ids(status: DataFrame) -> DataFrame:
    """The ids that are ok; an error if there is none."""
    ok = status.where("status = 'ok'").select("pmid")
    if ok.isEmpty():
        raise NoValidIds(status.where("status = 'broken'").select("pmid"))
    return ok


def shuffle_order(seed: int, key: str = "pmid") -> Column:
    """A seeded order that other engines can compute too."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


#: Hexadecimal digits of a hash that samples are counted by: 65,536 beginnings at most.
HEAD = 4


def random_subset(pool: DataFrame, k: int, seed: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """``k`` rows without replacement, not in ``exclude``; the same for the same seed.

    They are those with the smallest hashes. Counts of the hashes' beginnings tell which are small enough without a sort of the
    pool; only rows with the one beginning in which the sample ends are sorted.
    """
    rows = without(pool, exclude)
    head = F.substring(shuffle_order(seed), 1, HEAD)
    left, bound = k, None
    # a row for each beginning
    for r in sorted(rows.groupBy(head.alias("head")).agg(F.count("*").alias("n")).collect(), key=lambda r: (r["head"] is not None, r["head"])):
        if r.n >= left:
            bound = r["head"]
            break
        left -= r.n
    else:
        return rows
    whole = F.lit(False) if bound is None else (head < bound) | head.isNull()
    return rows.where(whole).unionByName(rows.where(head.eqNullSafe(F.lit(bound))).orderBy(shuffle_order(seed), "pmid").limit(left))


def negatives(pool: DataFrame, positives: DataFrame, wanted: int | DataFrame, seed: int = 1) -> DataFrame:
    """(pmid): a random sample of so many, or given ids less the positives and unknown ones."""
    if isinstance(wanted, int):
        return random_subset(pool.select("pmid"), wanted, seed, positives)
    return id_status(wanted, pool, positives).where("status = 'ok'").select("pmid")


def truepos_vs_rank(ranked_rows: DataFrame, known: DataFrame) -> DataFrame:
    """rank, tp, precision, recall: how many known ids are among the first so many."""
    flagged = ranked_rows.join(known.select("pmid").distinct().withColumn("hit", F.lit(1)), "pmid", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    total = known.agg(F.count_distinct("pmid").alias("relevant"))
    rows = running(flagged, ["rank"], {"tp": "hit"}).crossJoin(F.broadcast(total))
    return rows.select("rank", "pmid", "tp", (F.col("tp") / F.col("rank")).alias("precision"), F.try_divide(F.col("tp"), F.col("relevant")).alias("recall"))


def retrieval_test(docs: DataFrame, vocab: DataFrame, relevant: DataFrame, year: int, known_negatives: int = 0, params: Params = Params()) -> DataFrame:
    """Learn from relevant documents before ``year``, search that year, and follow the true positives down the ranks."""
    low, high = year * 10000 + 101, year * 10000 + 1231
    dated = docs.join(relevant.select("pmid").distinct(), "pmid", "left_semi").select("pmid", "date_key")
    older, test = dated.where(F.col("date_key") < low).select("pmid"), between(dated, low, high).select("pmid")
    limit = test.count() + known_negatives
    params = params.but(mindate=low, maxdate=high, limit=limit, threshold=None)
    model = learn(docs, vocab, older, params)
    return truepos_vs_rank(retrieve(docs, model, params, older), test)
