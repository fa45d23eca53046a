"""Metrics of labelled scores (pmid, label, score): curves over thresholds, areas, averages, ranges over folds.

Everything starts from one row per distinct (rounded) score. Sums over thresholds go by
ranges of scores, so no task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.order import running, with_next
from gleaner.session import Cuts


def _totals(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum("pe").alias("p"), F.sum("ne").alias("n"))


def confusion_curve(labelled: DataFrame) -> DataFrame:
    """score, pe, ne, tp, fp, tn, fn: predicted relevant are scores of at least ``score``."""
    ties = labelled.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pe"), F.count_if(F.col("label") != 1).alias("ne"))
    sums = running(ties, [F.desc("score")], {"tp": "pe", "fp": "ne"})
    sums = sums.crossJoin(F.broadcast(_totals(sums)))
    return sums.select("score", "pe", "ne", "tp", "fp", (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))


def ratio_curve(curve: DataFrame, alpha: float = 0.5, utility: float | None = None) -> DataFrame:
    """Adds tpr, fpr, ppv, fm, fma and u. ``utility`` defaults to the ratio of negatives to positives."""
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    tpr, fpr = F.try_divide(F.col("tp"), p), F.try_divide(F.col("fp"), n)
    ppv = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    ur = F.lit(float(utility)) if utility is not None else F.try_divide(n, p)
    out = curve.withColumns({"tpr": tpr, "fpr": fpr, "ppv": ppv, "u": F.try_divide(ur * F.col("tp") - F.col("fp"), ur * p)})
    both = (F.col("tpr") > 0) & (F.col("ppv") > 0)
    return out.withColumn("fm", F.when(both, 2 * F.col("tpr") * F.col("ppv") / (F.col("tpr") + F.col("ppv"))).otherwise(0.0)).withColumn("fma", F.when(both, 1 / (alpha / F.col("ppv") + (1 - alpha) / F.col("tpr"))).otherwise(0.0))


def curve_areas(ratios: DataFrame) -> DataFrame:
    """roc_area, pr_area: trapezoids between observed points only."""
    pairs = with_next(ratios.select("score", "tpr", "fpr", "ppv"), [F.desc("score")], {"tpr_": "tpr", "fpr_": "fpr", "ppv_": "ppv"})
    step = lambda y, x: (F.col(f"{x}_") - F.col(x)) * (F.col(f"{y}_") + F.col(y)) / 2
    return pairs.select(step("tpr", "fpr").alias("a"), step("ppv", "tpr").alias("b")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("roc_area"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("pr_area"))


def roc_error(curve: DataFrame) -> DataFrame:
    """w, q1, q2, w_stderr: Wilcoxon's area with Hanley and McNeil's standard error."""
    d = lambda c: F.col(c).cast("double")
    ne, pe, above, below = d("ne"), d("pe"), d("tp") - d("pe"), d("tn")
    rows = curve.crossJoin(F.broadcast(_totals(curve))).groupBy("p", "n").agg(
        F.sum(ne * above + 0.5 * ne * pe).alias("won"), F.sum(pe * (below * below + below * ne + ne * ne / 3)).alias("won_twice_by_one_positive"), F.sum(ne * (above * above + above * pe + pe * pe / 3)).alias("lost_twice_by_one_negative")
    )
    p, n = d("p"), d("n")
    rows = rows.select("p", "n", F.try_divide(F.col("won"), n * p).alias("w"), F.try_divide(F.col("lost_twice_by_one_negative"), n * p * p).alias("q1"), F.try_divide(F.col("won_twice_by_one_positive"), p * n * n).alias("q2"))
    w2 = F.col("w") * F.col("w")
    error = F.try_divide(F.col("w") * (1 - F.col("w")) + (p - 1) * (F.col("q1") - w2) + (n - 1) * (F.col("q2") - w2), p * n)
    return rows.select("w", "q1", "q2", F.sqrt(error).alias("w_stderr"))


def averaged_precision(labelled: DataFrame) -> DataFrame:
    """avprec: precision averaged over the ranks of relevant documents; at ties relevant ones come first.

    Within a tie the k-th relevant document has tp + k relevant ones among tp + fp + k, so
    one row per distinct score is enough.
    """
    curve = confusion_curve(labelled).where("pe > 0")
    before_tp, before_fp = F.col("tp") - F.col("pe"), F.col("fp") - F.col("ne")
    rows = curve.select(before_tp.alias("a"), before_fp.alias("b"), F.explode(F.sequence(F.lit(1).cast("long"), "pe")).alias("k"))
    return rows.agg(F.avg((F.col("a") + F.col("k")) / (F.col("a") + F.col("b") + F.col("k"))).alias("avprec"))


def breakeven(ratios: DataFrame, digits: int = 9) -> DataFrame:
    """score, breakeven: the lowest threshold where recall and precision are closest, and their mean."""
    gap = F.round(F.abs(F.col("tpr") - F.col("ppv")), digits)
    return ratios.select("score", ((F.col("tpr") + F.col("ppv")) / 2).alias("breakeven"), gap.alias("gap")).orderBy("gap", "score").limit(1).select("score", "breakeven")


def precision_11(ratios: DataFrame) -> DataFrame:
    """recall 0, 0.1 … 1 and the largest precision at that recall or more, 0 if there is none.

    Eleven conditional maxima in one pass.
    """
    maxima = [F.coalesce(F.max(F.when(F.col("tpr") >= k / 10 - 1e-12, F.col("ppv"))), F.lit(0.0)).alias(f"p{k}") for k in range(11)]
    row = ratios.agg(*maxima)
    return row.select(F.explode(F.array(*(F.struct(F.lit(k / 10).alias("recall"), F.col(f"p{k}").alias("precision")) for k in range(11)))).alias("x")).select("x.recall", "x.precision")


def threshold_maximising(ratios: DataFrame, column: str, digits: int = 9) -> DataFrame:
    """The row with the column's largest value, the lowest threshold at ties."""
    return ratios.orderBy(F.desc(F.round(column, digits)), "score").limit(1)


def index_for(curve: DataFrame, threshold: float) -> DataFrame:
    """score: the smallest observed one of at least ``threshold``, else the largest."""
    return curve.agg(F.coalesce(F.min(F.when(F.col("score") >= threshold, F.col("score"))), F.max("score")).alias("score"))


def performance(matrix: DataFrame, alpha: float = 0.5, utility: float | Column | None = None) -> DataFrame:
    """Adds to rows with tp, tn, fp, fn everything that follows from them."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    zero, one = F.lit(0.0), F.lit(1.0)
    over = lambda a, b, other: F.when(b > 0, a / b).otherwise(other)
    m = matrix.withColumns({"p": tp + fn, "n": tn + fp, "a": tp + tn + fp + fn, "t": tp + tn, "f": fp + fn})
    p, n, a = F.col("p"), F.col("n"), F.col("a")
    m = m.withColumns({"tpr": over(tp, p, zero), "fnr": over(fn, p, zero), "tnr": over(tn, n, zero), "fpr": over(fp, n, zero), "ppv": over(tp, tp + fp, one), "npv": over(tn, tn + fn, one), "accuracy": over(F.col("t"), a, zero), "prevalence": over(p, a, zero), "fp_tp_ratio": over(fp, tp, zero)})
    tpr, ppv = F.col("tpr"), F.col("ppv")
    ur = utility if isinstance(utility, Column) else F.lit(float(utility)) if utility is not None else F.try_divide(n, p)
    m = m.withColumn("utility_r", ur)
    both = (tpr > 0) & (ppv > 0)
    return m.withColumns({
        "fdr": 1 - ppv, "error": 1 - F.col("accuracy"), "enrichment": over(ppv, F.col("prevalence"), zero),
        "utility": F.try_divide(F.col("utility_r") * tp - fp, F.col("utility_r") * p),
        "fmeasure": F.when(both, 2 * tpr * ppv / (tpr + ppv)).otherwise(zero),
        "fmeasure_alpha": F.when(both, 1 / (alpha / ppv + (1 - alpha) / tpr)).otherwise(zero),
    })


METRICS = ("tp", "tn", "fp", "fn", "p", "n", "a", "t", "f", "tpr", "fnr", "tnr", "fpr", "ppv", "npv", "accuracy", "prevalence", "fp_tp_ratio", "fdr", "error", "enrichment", "utility", "fmeasure", "fmeasure_alpha")


def matrix_at(labelled: DataFrame, threshold: float | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, tn, fp, fn at a threshold, for each value of ``by`` (folds)."""
    pos, hit = F.col("label") == 1, F.col("score") >= threshold
    return labelled.groupBy(*by).agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"))


def performance_range(labelled: DataFrame, threshold: float, alpha: float = 0.5, utility: float | None = None) -> DataFrame:
    """metric, average, minimum, maximum: the pooled value and the extremes over folds, which start from it."""
    names = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))
    pooled = performance(matrix_at(labelled, threshold), alpha, utility)
    long = lambda df: df.select(F.explode(names).alias("x")).select("x.metric", "x.value")
    parts = matrix_at(labelled, threshold, ("fold",)).crossJoin(F.broadcast(pooled.select(F.col("utility_r").alias("_ur"))))
    ranges = long(performance(parts, alpha, F.col("_ur"))).groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    both = long(pooled).join(ranges, "metric")
    return both.select("metric", F.col("value").alias("average"), F.least("value", "low").alias("minimum"), F.greatest("value", "high").alias("maximum"))


def operating_point(labelled: DataFrame, threshold: float | None = 0.0, alpha: float = 0.5, utility: float | None = None) -> DataFrame:
    """The curve's row for a threshold, or for the largest weighted F if it is None."""
    ratios = ratio_curve(confusion_curve(labelled), alpha, utility)
    if threshold is None:
        return threshold_maximising(ratios, "fma")
    return ratios.join(F.broadcast(index_for(ratios, threshold)), "score")


def bin_count(values: DataFrame, column: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """n, least, most, bins, for each group of ``by``: range over twice the inter-quartile range times the cube root of n, within 10 and 150.

    Quartiles are the values at places 3n div 4 and n div 4 of the sorted list; only counts
    per distinct value are sorted, by ranges of (group, value).
    """
    ties = values.groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("k"))
    placed = running(ties, ["v"], {"upto": "k"}, by=by)
    sizes = ties.groupBy(F.struct(*by, F.lit(0)).alias("_g")).agg(F.sum("k").alias("n"))
    placed = placed.join(sizes if by else F.broadcast(sizes), F.struct(*by, F.lit(0)).eqNullSafe(F.col("_g")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    q = placed.groupBy(*by, "n").agg(at(F.expr("(3 * n) div 4")).alias("high"), at(F.expr("n div 4")).alias("low"), (F.max("v") - F.min("v")).alias("r"), F.min("v").alias("least"), F.max("v").alias("most"))
    width = 2 * (F.col("high") - F.col("low")) * F.pow("n", F.lit(-1 / 3))
    bins = F.coalesce(F.floor(F.try_divide(F.col("r"), width)), F.lit(150))
    return q.select(*by, "n", "least", "most", F.least(F.lit(150), F.greatest(F.lit(10), bins)).cast("int").alias("bins"))


def histogram(values: DataFrame, column: str = "score", by: tuple[str, ...] = (), density: bool = True, empty_as: float = 0.0) -> DataFrame:
    """bin, left, n, mass, and ``by``: equal bins between each group's extremes, the last one closed; every bin has a row.

    ``mass`` is normalised to area 1 if ``density``, else the count; ``empty_as`` stands for empty bins. All
    groups are one plan, however many there are.
    """
    values = values.where(F.col(column).isNotNull())
    shape = Cuts(values.sparkSession, "bins").write(bin_count(values, column, by))
    width = (F.col("most") - F.col("least")) / F.col("bins")
    at = F.least(F.col("bins") - 1, F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("least"), width), F.lit(0.0)))).cast("int")
    group = F.struct(*by, F.lit(0))
    told = shape.select(group.alias("_g"), "least", "most", "bins")
    counts = values.join(told if by else F.broadcast(told), group.eqNullSafe(F.col("_g"))).select("_g", at.alias("bin")).groupBy("_g", "bin").agg(F.count("*").alias("k"))
    counts = counts.withColumnRenamed("bin", "_bin")
    every = shape.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    rows = every.join(counts, group.eqNullSafe(F.col("_g")) & (F.col("bin") == F.col("_bin")), "left").withColumn("k", F.coalesce("k", F.lit(0)))
    mass = F.coalesce(F.try_divide(F.col("k"), F.col("n") * width), F.lit(0.0)) if density else F.col("k").cast("double")
    return rows.select(*by, "bin", (F.col("least") + F.col("bin") * width).alias("left"), F.col("k").alias("count"), F.when(F.col("k") == 0, F.lit(float(empty_as))).otherwise(mass).alias("mass"))


def feature_histogram(weights: DataFrame) -> DataFrame:
    """Of the weights of selected features that occur; empty bins count 1, for a log axis."""
    return histogram(weights.where("selected and pos + neg > 0"), "score", density=False, empty_as=1.0)


#: A kernel ends where it is 1e-12 of its height: so many widths from its middle.
REACH = 7.44


def kernel_density(values: DataFrame, column: str = "score", points: int = 512) -> DataFrame:
    """x, density: Gaussian kernels of width n^(-1/5) sigma over an even grid between the extremes.

    Values are first counted, and each distinct one meets only the grid points that its kernel reaches. Values that are all
    equal have no density.
    """
    ties = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    stats = values.agg(F.count(column).alias("n"), F.stddev_pop(column).alias("sd"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    stats = stats.where("hi > lo").select("n", "lo", (F.pow("n", F.lit(-0.2)) * F.col("sd")).alias("h"), ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"))
    place = lambda x: (x - F.col("lo")) / F.col("step")
    first = F.greatest(F.lit(0), F.ceil(place(F.col("v") - REACH * F.col("h"))).cast("int"))
    last = F.least(F.lit(points - 1), F.floor(place(F.col("v") + REACH * F.col("h"))).cast("int"))
    # one row of statistics; a kernel between two grid points reaches none
    met = ties.crossJoin(F.broadcast(stats)).withColumns({"_first": first, "_last": last}).where("_first <= _last").select("v", "k", "n", "h", "lo", "step", F.explode(F.sequence("_first", "_last")).alias("i"))
    z = (F.col("lo") + F.col("step") * F.col("i") - F.col("v")) / F.col("h")
    sums = met.groupBy("i").agg(F.sum(F.col("k") * F.exp(-z * z / 2) / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    return grid.join(sums, "i", "left").select((F.col("lo") + F.col("step") * F.col("i")).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def interpolated(curve: DataFrame, x: str, y: str, points: int = 8000, least: int = 12000) -> DataFrame:
    """The curve at evenly spaced x by straight lines, if it has ``least`` points; else itself.

    Each stretch between neighbours makes the grid points inside it.
    """
    shape = curve.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"))
    pairs = with_next(curve.select(F.col(x).alias("x0"), F.col(y).alias("y0")), ["x0", "y0"], {"x1": "x0", "y1": "y0"}).crossJoin(F.broadcast(shape))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    first, last = F.ceil((F.col("x0") - F.col("lo")) / step - 1e-9), F.ceil((F.col("x1") - F.col("lo")) / step - 1e-9) - 1
    inside = pairs.where((F.col("n") >= least) & F.col("x1").isNotNull()).where(last >= first).select("x0", "y0", "x1", "y1", "lo", "hi", F.explode(F.sequence(first, last)).alias("i"))
    at = F.col("lo") + F.col("i") * step
    made = inside.select(at.alias(x), (F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0"))).alias(y))
    ends = pairs.where((F.col("n") >= least) & F.col("x1").isNull()).select(F.col("x0").alias(x), F.col("y0").alias(y))
    short = curve.select(x, y).crossJoin(F.broadcast(shape.select("n"))).where(F.col("n") < least).select(x, y)
    return made.unionByName(ends).unionByName(short)


def summary(labelled: DataFrame, threshold: float | None = 0.0, alpha: float = 0.5, utility: float | None = None) -> DataFrame:
    """One row: operating point, areas, W with its error, averaged precision, break-even."""
    curve = confusion_curve(labelled)
    ratios = ratio_curve(curve, alpha, utility)
    parts = [operating_point(labelled, threshold, alpha, utility), curve_areas(ratios), roc_error(curve), averaged_precision(labelled), breakeven(ratios).select(F.col("score").alias("breakeven_score"), "breakeven")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out
