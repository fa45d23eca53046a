"""Cross-validation in one plan: the fold is a column, not a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import Params
from gleaner.operators.model import train
from gleaner.operators.order import tiled
from gleaner.operators.retrieve import shuffle_order
from gleaner.session import Cuts


def folds(labelled: DataFrame, nfolds: int, seed: int | None = 1) -> DataFrame:
    """Adds ``fold`` from 0: contiguous blocks per class after a seeded shuffle; the first blocks are one larger.

    Seed 0 or None keeps the order of ids. Classes are numbered by range, so none is in one task.
    """
    order = ["_shuffled", "pmid"] if seed else ["pmid"]
    rows = labelled.withColumn("_shuffled", shuffle_order(seed)) if seed else labelled
    return tiled(rows, order, "fold", nfolds, by=["label"]).select(*labelled.columns, "fold")


def fold_sizes(items: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of each part."""
    each, more = divmod(items, parts)
    out, at = [], 0
    for k in range(parts):
        size = each + (k < more)
        out.append((at, size))
        at += size
    return out


def cross_validate(docs: DataFrame, vocab: DataFrame, folded: DataFrame, params: Params = Params()) -> DataFrame:
    """(pmid, label, fold, score): each document scored by a model of the other folds.

    ``folded`` has pmid, label and fold. The other folds' counts of a feature are the total less the fold's own. The prior is
    the plain log odds of all labelled documents; features are selected in each fold.

    A fold's documents have only features that the fold touches, so weights are needed for these pairs alone. What
    all features together weigh when absent is a sum over the vocabulary as if no fold touched any, where features with
    equal counts are one row, and a correction for each touched pair.
    """
    own = docs.join(folded.select("pmid", "label", "fold"), "pmid")
    long = own.select("pmid", "label", "fold", F.explode(F.array_distinct("features")).alias("fid"))
    is_pos = F.col("label") == 1
    cuts = Cuts(docs.sparkSession, "folds")
    by_fold = cuts.write(long.groupBy("fold", "fid").agg(F.count_if(is_pos).alias("own_pos"), F.count_if(~is_pos).alias("own_neg")))
    totals = by_fold.groupBy("fid").agg(F.sum("own_pos").alias("all_pos"), F.sum("own_neg").alias("all_neg"))
    sizes = own.groupBy("fold").agg(F.count_if(is_pos).alias("own_p"), F.count_if(~is_pos).alias("own_n"))
    whole = sizes.agg(F.sum("own_p").alias("all_p"), F.sum("own_n").alias("all_n"))
    per = sizes.crossJoin(F.broadcast(whole)).select(
        "fold", (F.col("all_p") - F.col("own_p")).alias("pdocs"), (F.col("all_n") - F.col("own_n")).alias("ndocs"), (F.col("all_p") + F.col("all_n")).alias("numdocs"),
        (F.lit(float(params.prior)) if params.prior is not None else F.log(F.col("all_p") / F.col("all_n"))).alias("prior"),
    )
    per = cuts.write(per)
    n = lambda c: F.coalesce(c, F.lit(0))
    counted = cuts.write(vocab.join(totals, "fid", "left").select("fid", "ftype", "fname", "df", n("all_pos").alias("all_pos"), n("all_neg").alias("all_neg")))
    # only one smoothing looks at the document frequency
    alike = ["ftype", "all_pos", "all_neg", *(["df"] if params.method == "bgfreq" else [])]
    kinds = counted.groupBy(*alike).agg(F.count("*").alias("features"), F.min("fid").alias("fid"), F.min("fname").alias("fname"), *([] if "df" in alike else [F.min("df").alias("df")]))
    untouched = kinds.crossJoin(F.broadcast(per.select("fold"))).select("fold", "fid", "ftype", "fname", "df", F.col("all_pos").alias("pos"), F.col("all_neg").alias("neg"), "features")
    touched = by_fold.join(counted, "fid")
    count = lambda df, pos, neg: df.select("fold", "fid", "ftype", "fname", "df", pos.alias("pos"), neg.alias("neg"))
    before = train(count(touched, F.col("all_pos"), F.col("all_neg")), per, params, by=["fold"], keep=("absent",)).weights
    after = train(count(touched, F.col("all_pos") - F.col("own_pos"), F.col("all_neg") - F.col("own_neg")), per, params, by=["fold"], keep=("absent",)).weights
    spare = train(untouched, per, params, by=["fold"], keep=("absent", "features")).weights
    parts = spare.select("fold", (F.col("absent") * F.col("features")).alias("part")).unionByName(after.select("fold", F.col("absent").alias("part"))).unionByName(before.select("fold", (-F.col("absent")).alias("part")))
    base = parts.groupBy("fold").agg(F.sum("part").alias("base"))
    scalars = per.select("fold", F.lit(0.0).alias("prior") if params.method == "rubin" else "prior").join(base, "fold", "left").select("fold", "prior", F.coalesce("base", F.lit(0.0)).alias("base"))
    useful = after.where("score <> 0").select("fold", "fid", F.col("score").alias("weight"))
    rows = own.select("pmid", "label", "fold", F.explode_outer(F.array_distinct("features")).alias("fid"))
    sums = rows.join(useful, ["fold", "fid"], "left").groupBy("pmid", "label", "fold").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("own"))
    return sums.join(F.broadcast(scalars), "fold").select("pmid", "label", "fold", (F.col("own") + F.col("base") + F.col("prior")).alias("score"))


def validation(docs: DataFrame, vocab: DataFrame, positives: DataFrame, negatives: DataFrame, params: Params = Params()) -> DataFrame:
    """Cross-validated scores of positives and negatives (pmid tables)."""
    labelled = positives.select("pmid", F.lit(1).alias("label")).unionByName(negatives.select("pmid", F.lit(0).alias("label")))
    known = labelled.join(docs.select("pmid"), "pmid", "left_semi")
    return cross_validate(docs, vocab, folds(known, params.folds, params.seed), params)
