"""Training: counts, feature selection, weights of a Bernoulli naive Bayes model.

A model is two tables: weights, one row per feature, and scalars, one row with pdocs, ndocs,
prior and base. The parts of a document's score that come from absent features are
summed once, in base, so scoring costs as much as a document has features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Params
from gleaner.session import Cuts

#: Stands for a zero frequency in the likelihood ratio.
LEAST_FREQUENCY = 1e-8


@dataclass(frozen=True)
class Model:
    weights: DataFrame
    scalars: DataFrame


def count_features(docs: DataFrame) -> DataFrame:
    """(fid, n): documents with each feature; a feature counts once per document."""
    return docs.select(F.explode(F.array_distinct("features")).alias("fid")).groupBy("fid").agg(F.count("*").alias("n"))


def background_docs(docs: DataFrame, mindate: int | None, maxdate: int | None, exclude: DataFrame | None) -> DataFrame:
    from gleaner.operators.retrieve import between, without

    return without(between(docs, mindate, maxdate), exclude)


def written_ids(ids: DataFrame, cuts: Cuts) -> DataFrame:
    """(pmid): distinct ids, written, so that their own size and not that of the table they are taken from tells how they are joined."""
    return cuts.write(ids.select("pmid").distinct())


def counts_by_subtraction(docs: DataFrame, vocab: DataFrame, positives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts with the rest of the corpus as background, without a second scan of it.

    Returns (fid, ftype, fname, df, pos, neg) and one row (pdocs, ndocs, numdocs), both written: models read them often.
    """
    cuts = Cuts(docs.sparkSession, "counts")
    relevant = docs.join(written_ids(positives, cuts), "pmid", "left_semi")
    pos = count_features(relevant).withColumnRenamed("n", "pos")
    counts = vocab.join(pos, "fid", "left").withColumn("pos", F.coalesce("pos", F.lit(0))).withColumn("neg", F.col("df") - F.col("pos"))
    totals = relevant.agg(F.count("*").alias("pdocs")).crossJoin(docs.agg(F.count("*").alias("numdocs")))
    return cuts.write(counts), cuts.write(totals.select("pdocs", (F.col("numdocs") - F.col("pdocs")).alias("ndocs"), "numdocs"))


def counts_dated(docs: DataFrame, vocab: DataFrame, positives: DataFrame, mindate: int | None = None, maxdate: int | None = None, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts with a background of its own dates, without ``exclude`` (the positives if not given); both tables are written."""
    cuts = Cuts(docs.sparkSession, "counts")
    ids = written_ids(positives, cuts)
    relevant = docs.join(ids, "pmid", "left_semi")
    rest = background_docs(docs, mindate, maxdate, ids if exclude is None else exclude)
    pos, neg = count_features(relevant).withColumnRenamed("n", "pos"), count_features(rest).withColumnRenamed("n", "neg")
    counts = vocab.join(pos, "fid", "left").join(neg, "fid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pos", "neg")})
    totals = relevant.agg(F.count("*").alias("pdocs")).crossJoin(rest.agg(F.count("*").alias("ndocs"))).crossJoin(docs.agg(F.count("*").alias("numdocs")))
    return cuts.write(counts), cuts.write(totals)


def prior(given: float | None = None) -> Column:
    """Log odds of relevance, with one document added to each class, unless given."""
    return F.lit(float(given)) if given is not None else F.log((F.col("pdocs") + 1.0) / (F.col("ndocs") + 1.0))


def infogain() -> Column:
    """Relative information gain of (feature, class), in terms of pos, neg, pdocs and ndocs.

    Mutual information in bits over the entropy of the class; parts without documents are 0.
    """
    r, i = F.col("pdocs").cast("double"), F.col("ndocs").cast("double")
    n = r + i
    r1, i1 = F.col("pos").cast("double"), F.col("neg").cast("double")

    def part(joint: Column, of_class: Column, of_feature: Column) -> Column:
        return F.when((joint <= 0) | (of_feature <= 0), F.lit(0.0)).otherwise(joint / n * F.log2(joint * n / (of_class * of_feature)))

    bits = part(r1, r, r1 + i1) + part(i1, i, r1 + i1) + part(r - r1, r, n - r1 - i1) + part(i - i1, i, n - r1 - i1)
    entropy = -(r / n) * F.log2(r / n) - (i / n) * F.log2(i / n)
    return F.when((r <= 0) | (i <= 0), F.lit(0.0)).otherwise(bits / entropy)


def selected(mincount: int = 0, min_infogain: float = 0.0, positives_only: bool = False, masked: Sequence[str] = ()) -> Column:
    """All conditions on a feature together."""
    keep = ~F.col("ftype").isin(list(masked)) if masked else F.lit(True)
    if mincount > 0:
        keep = keep & (F.col("pos") + F.col("neg") >= mincount)
    if positives_only:
        keep = keep & (F.col("pos") != 0)
    if min_infogain > 0:
        keep = keep & (F.col("infogain") >= min_infogain)
    return keep


def _laplace():
    return F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)


def _laplace_split():
    p = (F.col("pdocs") + 1.0) / (F.col("pdocs") + F.col("ndocs") + 2.0)
    return 2 * p, 4 * p, 2 * (1 - p), 4 * (1 - p)


def _bgfreq():
    a = F.col("df").cast("double") / F.col("numdocs")
    return a, F.lit(1.0), a, F.lit(1.0)


SMOOTHING = {"laplace": _laplace, "laplace_split": _laplace_split, "bgfreq": _bgfreq}


def _frequencies(method: str) -> tuple[Column, Column]:
    p, n, np_, nn = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("pdocs"), F.col("ndocs")
    if method == "rubin":
        return F.when(p == 0, LEAST_FREQUENCY).otherwise(F.try_divide(p, np_)), F.when(n == 0, LEAST_FREQUENCY).otherwise(F.try_divide(n, nn))
    pa, pab, na, nab = SMOOTHING[method]()
    return (pa + p) / (pab + np_), (na + n) / (nab + nn)


def train(counts: DataFrame, totals: DataFrame, params: Params = Params(), by: Sequence[str] = (), keep: Sequence[str] = ()) -> Model:
    """Weights and scalars from counts and totals.

    ``by`` names columns that both tables have, if there are several models at once: folds. ``keep`` names further columns
    of the weights: any of the counts, or ``absent``, what a feature weighs where a document lacks it.
    """
    keys = list(by)
    totals = totals.withColumn("prior", prior(params.prior)) if "prior" not in totals.columns else totals
    joined = counts.join(F.broadcast(totals), keys) if keys else counts.crossJoin(F.broadcast(totals))
    rows = joined.withColumn("infogain", infogain())
    rows = rows.withColumn("selected", selected(params.mincount, params.min_infogain, params.positives_only, params.type_mask))
    pf, nf = _frequencies(params.method)
    rows = rows.withColumn("pfreq", pf).withColumn("nfreq", nf)
    present = F.log(F.col("pfreq")) - F.log(F.col("nfreq"))
    absent = F.lit(0.0) if params.method == "rubin" else F.log1p(-F.col("pfreq")) - F.log1p(-F.col("nfreq"))
    # a feature that no document has gives logs of zero under some smoothing; it weighs nothing
    possible = (F.col("pfreq") > 0) & (F.col("nfreq") > 0) & (F.col("pfreq") < 1) & (F.col("nfreq") < 1) if params.method != "rubin" else F.lit(True)
    use = F.col("selected") & possible
    rows = rows.withColumn("absent", F.when(use, absent).otherwise(0.0)).withColumn("score", F.when(use, present - F.col("absent")).otherwise(0.0))
    base = rows.groupBy(*keys).agg(F.sum("absent").alias("base"))
    base = base if keys else base.select(F.coalesce("base", F.lit(0.0)).alias("base"))
    scalars = totals.join(base, keys) if keys else totals.crossJoin(base)
    if params.method == "rubin":
        scalars = scalars.withColumn("prior", F.lit(0.0))
    weights = rows.select(*keys, "fid", "ftype", "fname", "df", "pos", "neg", "selected", "infogain", "pfreq", "nfreq", "score", *keep)
    return Model(weights, scalars)


def feature_stats(model: Model, masked: Sequence[str] = ()) -> DataFrame:
    """One row about a model's features: how many, how often, on average."""
    w = model.weights
    open_ = ~F.col("ftype").isin(list(masked)) if masked else F.lit(True)
    sel = F.col("selected")
    stats = w.agg(
        F.count_if(sel).alias("feats_selected"),
        F.count("*").alias("feats_total"),
        F.count_if(open_ & (F.col("pos") + F.col("neg") > 0)).alias("feats_in_data"),
        *(F.coalesce(F.sum(F.when(sel, F.col(c))), F.lit(0)).alias(f"{c}_occurrences") for c in ("pos", "neg")),
        *(F.count_if(sel & (F.col(c) > 0)).alias(f"{c}_distinct") for c in ("pos", "neg")),
    )
    rows = stats.crossJoin(F.broadcast(model.scalars.select("pdocs", "ndocs")))
    return rows.withColumns({
        "aggressivity": F.try_divide(F.col("feats_in_data"), F.col("feats_selected")),
        "pos_average": F.try_divide(F.col("pos_occurrences"), F.col("pdocs")),
        "neg_average": F.try_divide(F.col("neg_occurrences"), F.col("ndocs")),
    })


def tfidf(model: Model) -> DataFrame:
    """fid, ftype, fname, score, pos, neg, tfidf of selected features; the positives are one document."""
    rows = model.weights.where("selected")
    total = rows.agg(F.sum("pos").alias("all_pos"))
    rows = rows.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(model.scalars.select("pdocs", "ndocs")))
    df = F.col("pos") + F.col("neg")
    idf = F.when(df == 0, 0.0).otherwise(F.log((F.col("pdocs") + F.col("ndocs")) / df))
    return rows.select("fid", "ftype", "fname", "score", "pos", "neg", (F.coalesce(F.try_divide(F.col("pos"), F.col("all_pos")), F.lit(0.0)) * idf).alias("tfidf"))


def top_tfidf(model: Model, most: int = 20, least: float = 0.001) -> DataFrame:
    """The first ``most`` by rounded value and id, and of these the ones of at least ``least``."""
    rows = tfidf(model).withColumn("tfidf", F.round("tfidf", 9))
    return rows.orderBy(F.desc("tfidf"), F.desc("fid")).limit(most).where(F.col("tfidf") >= least)


def feature_table(model: Model, most: int | None = None) -> DataFrame:
    """score, relIG, pos_count, neg_count, termid, type, term of selected features, best first."""
    rows = model.weights.where("selected").withColumn("rounded", F.round("score", 6)).orderBy(F.desc("rounded"), F.desc("fid"))
    rows = rows if most is None else rows.limit(most)
    return rows.select(F.col("rounded").alias("score"), F.round("infogain", 9).alias("relIG"), F.col("pos").alias("pos_count"), F.col("neg").alias("neg_count"), F.col("fid").alias("termid"), F.col("ftype").alias("type"), F.col("fname").alias("term"))


def best_features(weights: DataFrame) -> DataFrame:
    """Selected features by rank of weight."""
    return weights.where("selected").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("fid"))))
