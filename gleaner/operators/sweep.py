"""Many configurations at once: weights are keyed by configuration, so one scan of the corpus scores all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Params
from gleaner.operators import blocks, dense
from gleaner.operators.model import Model, train
from gleaner.session import Cuts


def train_all(counts: DataFrame, totals: DataFrame, grid: Mapping[str, Params]) -> Model:
    """One model per configuration in the same two tables, with a column ``config``."""
    weights = scalars = None
    for name, params in grid.items():
        m = train(counts, totals, params)
        w = m.weights.withColumn("config", F.lit(name))
        s = m.scalars.withColumn("config", F.lit(name))
        weights = w if weights is None else weights.unionByName(w)
        scalars = s if scalars is None else scalars.unionByName(s)
    if weights is None:
        raise ValueError("no configuration")
    return Model(weights, scalars)


def score_all(docs: DataFrame, model: Model) -> DataFrame:
    """(config, pmid, score); a document without weighted features still has a row per configuration.

    A feature's weights in all configurations are one row, so the corpus is read once and its rows are not multiplied;
    sums are written with a column for each configuration, of which each configuration's rows read one.
    """
    cuts = Cuts(docs.sparkSession, "sweep")
    scalars = {r.config: (r.base, r.prior) for r in model.scalars.select("config", "base", "prior").collect()}
    names = sorted(scalars)
    own = [f"s{i}" for i in range(len(names))]
    useful = cuts.write(model.weights.where("score <> 0").groupBy("fid").agg(*(F.coalesce(F.sum(F.when(F.col("config") == n, F.col("score"))), F.lit(0.0)).alias(c) for c, n in zip(own, names, strict=True))))
    if (weights := dense.table(useful, own)) is not None:
        sums = dense.summed(docs, weights, own)
    else:
        sums = blocks.summed(docs, useful, own)
    sums, out = cuts.write(sums), None
    for c, n in zip(own, names, strict=True):
        one = sums.select(F.lit(n).alias("config"), "pmid", (F.col(c) + F.lit(scalars[n][0]) + F.lit(scalars[n][1])).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def ranked_all(scores: DataFrame, limit: int, digits: int = 6) -> DataFrame:
    """(config, rank, pmid, score): the best of each configuration.

    Each task keeps its best rows only, so no configuration's rows are sorted; the window sees the best of all.
    """
    rows, best = scores.withColumn("score", F.round("score", digits)), None
    for r in scores.select("config").distinct().collect():
        one = rows.where(F.col("config").eqNullSafe(F.lit(r.config))).orderBy(F.desc("score"), F.desc("pmid")).limit(limit)
        best = one if best is None else best.unionByName(one)
    rows = rows if best is None else best
    order = Window.partitionBy("config").orderBy(F.desc("score"), F.desc("pmid"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("config", "rank", "pmid", "score")


def smoothing_grid(base: Params = Params()) -> dict[str, Params]:
    return {m: base.but(method=m) for m in ("laplace", "laplace_split", "bgfreq", "rubin")}


def cutoff_grid(base: Params = Params()) -> dict[str, Params]:
    """Cut-offs of document frequency and information gain, and positives only."""
    out = {f"df{n}": base.but(mincount=n, min_infogain=0.0) for n in (0, 2, 5, 10)}
    out |= {f"ig{x:g}": base.but(mincount=0, min_infogain=x) for x in (1e-6, 1e-5, 2e-5, 1e-4, 1e-3)}
    return out | {"positives": base.but(positives_only=True)}


def mask_grid(base: Params, types: tuple[str, ...]) -> dict[str, Params]:
    """All types, and each alone."""
    return {"all": base} | {t: base.but(type_mask=tuple(x for x in types if x != t)) for t in types}
