"""SQL twins of the catalogue's queries, for an engine with list functions and RE2 patterns.

Each is written from the definitions, not from the plans: common table expressions that a
query needs are put before its own SELECT.
"""

from __future__ import annotations

from gleaner.functions.stopwords import default_stopwords
from gleaner.plans.catalog import DRUGS, FOLDS, GENES, HIGH, LATER, LEAST_SCORE, LOW, SEED

ORACLE: dict[str, str] = {}

# ---- the basket corpus

BASKET = """
lp AS (SELECT l_orderkey AS pmid, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
long AS (SELECT * FROM (
  SELECT pmid, 'brand' AS ftype, p_brand AS fname FROM lp UNION SELECT pmid, 'type', p_type FROM lp
  UNION SELECT pmid, 'size', p_size FROM lp UNION SELECT pmid, 'flag', l_returnflag FROM lp) WHERE fname IS NOT NULL),
art AS (SELECT o_orderkey AS pmid, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key FROM orders),
relevant AS (SELECT o_orderkey AS pmid FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 10 = 0),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY ftype, fname) AS INTEGER) AS fid, ftype, fname, df FROM (SELECT ftype, fname, count(*) AS df FROM long GROUP BY ftype, fname)),
ids AS (SELECT pmid, fid FROM long JOIN vocab USING (ftype, fname))"""

COUNTS = """
pc AS (SELECT fid, count(*) AS pos FROM ids JOIN relevant USING (pmid) GROUP BY fid),
cnt AS (SELECT fid, ftype, fname, df, coalesce(pos, 0) AS pos, df - coalesce(pos, 0) AS neg FROM vocab LEFT JOIN pc USING (fid)),
tot AS (SELECT p AS pdocs, a - p AS ndocs, a AS numdocs FROM (SELECT (SELECT count(*) FROM relevant JOIN art USING (pmid)) AS p, (SELECT count(*) FROM art) AS a))"""

DATED = f"""
pc AS (SELECT fid, count(*) AS pos FROM ids JOIN relevant USING (pmid) GROUP BY fid),
rest AS (SELECT pmid FROM art WHERE date_key BETWEEN {LOW} AND {HIGH} AND pmid NOT IN (SELECT pmid FROM relevant)),
nc AS (SELECT fid, count(*) AS neg FROM ids JOIN rest USING (pmid) GROUP BY fid),
cnt AS (SELECT fid, ftype, fname, df, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM vocab LEFT JOIN pc USING (fid) LEFT JOIN nc USING (fid)),
tot AS (SELECT (SELECT count(*) FROM relevant JOIN art USING (pmid)) AS pdocs, (SELECT count(*) FROM rest) AS ndocs, (SELECT count(*) FROM art) AS numdocs)"""

_SMOOTH = {
    "laplace": ("1.0", "2.0", "1.0", "2.0"),
    "laplace_split": ("2 * pi", "4 * pi", "2 * (1 - pi)", "4 * (1 - pi)"),
    "bgfreq": ("CAST(df AS DOUBLE) / numdocs", "1.0", "CAST(df AS DOUBLE) / numdocs", "1.0"),
}


def _part(joint: str, of_class: str, of_feature: str) -> str:
    return f"CASE WHEN {joint} <= 0 OR {of_feature} <= 0 THEN 0.0 ELSE {joint} / m * log2({joint} * m / ({of_class} * {of_feature})) END"


def weights(method: str = "laplace_split", select: str = "true", name: str = "") -> str:
    """CTEs frq, wts and mdl (with a suffix) from cnt and tot."""
    ig = " + ".join((_part("r1", "r", "(r1 + i1)"), _part("i1", "i", "(r1 + i1)"), _part("(r - r1)", "r", "(m - r1 - i1)"), _part("(i - i1)", "i", "(m - r1 - i1)")))
    if method == "rubin":
        pf, nf = "CASE WHEN pos = 0 THEN 1e-8 ELSE CAST(pos AS DOUBLE) / pdocs END", "CASE WHEN neg = 0 THEN 1e-8 ELSE CAST(neg AS DOUBLE) / ndocs END"
        absent, use, log_odds = "0.0", "selected", "0.0"
    else:
        pa, pab, na, nab = _SMOOTH[method]
        pf, nf = f"({pa} + pos) / ({pab} + pdocs)", f"({na} + neg) / ({nab} + ndocs)"
        absent, use, log_odds = "ln(1 - pfreq) - ln(1 - nfreq)", "selected AND pfreq > 0 AND nfreq > 0 AND pfreq < 1 AND nfreq < 1", "ln((pdocs + 1.0) / (ndocs + 1.0))"
    return f"""
gain{name} AS (SELECT *, CASE WHEN r <= 0 OR i <= 0 THEN 0.0 ELSE ({ig}) / (-(r / m) * log2(r / m) - (i / m) * log2(i / m)) END AS infogain FROM (
  SELECT *, CAST(pdocs AS DOUBLE) AS r, CAST(ndocs AS DOUBLE) AS i, CAST(pdocs + ndocs AS DOUBLE) AS m, CAST(pos AS DOUBLE) AS r1, CAST(neg AS DOUBLE) AS i1, (pdocs + 1.0) / (pdocs + ndocs + 2.0) AS pi FROM cnt, tot)),
frq{name} AS (SELECT *, {select} AS selected, {pf} AS pfreq, {nf} AS nfreq FROM gain{name}),
absn{name} AS (SELECT *, CASE WHEN {use} THEN {absent} ELSE 0.0 END AS absent FROM frq{name}),
wts{name} AS (SELECT *, CASE WHEN {use} THEN ln(pfreq) - ln(nfreq) - absent ELSE 0.0 END AS score FROM absn{name}),
mdl{name} AS (SELECT pdocs, ndocs, numdocs, {log_odds} AS prior, (SELECT sum(absent) FROM wts{name}) AS base FROM tot)"""


def scores(name: str = "", docs: str = "art") -> str:
    return f"""
own{name} AS (SELECT pmid, sum(score) AS own FROM ids JOIN wts{name} USING (fid) GROUP BY pmid),
scr{name} AS (SELECT pmid, round(coalesce(own, 0.0) + base + prior, 6) AS score FROM {docs} LEFT JOIN own{name} USING (pmid), mdl{name})"""


def sql(select: str, *ctes: str) -> str:
    """A query of common table expressions; a select that begins with a comma brings more of them."""
    gap = "" if select.lstrip().startswith(",") else "\n"
    return f"WITH {','.join(c.strip() for c in ctes)}{gap}{select.lstrip()}"


def vector(table: str, fid: str = "fid") -> str:
    return f"SELECT pmid, string_agg(CAST({fid} AS VARCHAR), ' ' ORDER BY {fid}) AS features, count(*) AS n FROM {table} GROUP BY pmid"


ORACLE["doc_features_basket"] = sql("SELECT pmid, ftype, fname FROM long", BASKET)
ORACLE["vocabulary_df"] = sql("SELECT * FROM vocab", BASKET)
ORACLE["doc_vectors"] = sql(f"SELECT pmid, date_key, coalesce(features, '') AS features FROM art LEFT JOIN ({vector('ids')}) USING (pmid)", BASKET)
ORACLE["codec_round_trip"] = sql(
    """, gaps AS (SELECT pmid, fid, fid - coalesce(lag(fid) OVER (PARTITION BY pmid ORDER BY fid), 0) AS g FROM ids),
    codes AS (SELECT pmid, string_agg(CASE WHEN g < 128 THEN printf('%02x', g + 128) ELSE printf('%02x%02x', g // 128, g % 128 + 128) END, '' ORDER BY fid) AS code FROM gaps GROUP BY pmid)
    SELECT pmid, CAST(length(coalesce(code, '')) // 2 AS INTEGER) AS n_bytes, coalesce(code, '') AS code, true AS same FROM art LEFT JOIN codes USING (pmid)""",
    BASKET,
)
ORACLE["date_keys"] = """
SELECT o_orderkey AS pmid, k AS date_key, true AS back, CASE WHEN k >= 19650101 THEN k END AS parsed, k < 19650101 OR k < 20000301 - 1 AS valid
FROM (SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS k FROM orders)"""
ORACLE["pos_counts"] = sql("SELECT fid, pos AS n FROM cnt WHERE pos > 0", BASKET, COUNTS)
ORACLE["bg_counts_all"] = sql("SELECT fid, pos, neg FROM cnt", BASKET, COUNTS)
ORACLE["bg_counts_dated"] = sql("SELECT fid, pos, neg, pdocs, ndocs FROM cnt, tot", BASKET, DATED)
ORACLE["infogain"] = sql("SELECT fid, round(infogain, 9) + 0.0 AS infogain FROM wts", BASKET, COUNTS, weights())
_CHOSEN = "ftype <> 'flag' AND pos + neg >= 20 AND pos <> 0 AND infogain >= 1e-6"
ORACLE["select_features"] = sql("SELECT fid, selected FROM wts", BASKET, COUNTS, weights(select=_CHOSEN))
STATS = """SELECT count(*) FILTER (selected) AS feats_selected, count(*) AS feats_total, count(*) FILTER ({open}) AS feats_in_data,
    CAST(coalesce(sum(pos) FILTER (selected), 0) AS BIGINT) AS pos_occurrences, CAST(coalesce(sum(neg) FILTER (selected), 0) AS BIGINT) AS neg_occurrences,
    count(*) FILTER (selected AND pos > 0) AS pos_distinct, count(*) FILTER (selected AND neg > 0) AS neg_distinct, any_value(pdocs) AS pdocs, any_value(ndocs) AS ndocs,
    round(CAST(count(*) FILTER ({open}) AS DOUBLE) / count(*) FILTER (selected), 6) AS aggressivity,
    round(CAST(sum(pos) FILTER (selected) AS DOUBLE) / any_value(pdocs), 6) AS pos_average, round(CAST(sum(neg) FILTER (selected) AS DOUBLE) / any_value(ndocs), 6) AS neg_average FROM wts"""
ORACLE["feature_stats"] = sql(STATS.format(open="ftype <> 'flag' AND pos + neg > 0"), BASKET, COUNTS, weights(select="ftype <> 'flag' AND pos + neg >= 20"))
TOP_TERMS = """SELECT * FROM (SELECT fid, ftype, fname, pos, neg, round(CAST(pos AS DOUBLE) / (SELECT sum(pos) FROM wts) * CASE WHEN pos + neg = 0 THEN 0.0 ELSE ln((pdocs + ndocs) / CAST(pos + neg AS DOUBLE)) END, 9) AS tfidf
    FROM wts ORDER BY tfidf DESC, fid DESC LIMIT 20) WHERE tfidf >= 0.001"""
ORACLE["tfidf_top"] = sql(TOP_TERMS, BASKET, COUNTS, weights())
for _query, _method in {"weights_laplace": "laplace", "weights_split": "laplace_split", "weights_bgfreq": "bgfreq", "weights_ratio": "rubin"}.items():
    ORACLE[_query] = sql("SELECT fid, round(pfreq, 8) + 0.0 AS pfreq, round(nfreq, 8) + 0.0 AS nfreq, round(score, 8) + 0.0 AS score FROM wts", BASKET, COUNTS, weights(_method))
ORACLE["model_scalars"] = sql("SELECT pdocs, ndocs, numdocs, round(prior, 6) + 0.0 AS prior, round(base, 6) + 0.0 AS base FROM mdl", BASKET, COUNTS, weights())
ORACLE["feature_csv"] = sql(
    """SELECT round(score, 6) AS score, round(infogain, 9) AS "relIG", pos AS pos_count, neg AS neg_count, fid AS termid, ftype AS type, fname AS term
    FROM wts WHERE selected ORDER BY round(score, 6) DESC, fid DESC LIMIT 50""",
    BASKET, COUNTS, weights(select="pos + neg >= 2"),
)

RANKED = "SELECT CAST(row_number() OVER (ORDER BY score DESC, pmid DESC) AS INTEGER) AS rank, pmid, score FROM (SELECT * FROM scr{where} ORDER BY score DESC, pmid DESC LIMIT {limit})"
OTHERS = " WHERE pmid NOT IN (SELECT pmid FROM relevant)"
ORACLE["retrieve_topk"] = sql(RANKED.format(where=OTHERS, limit=500), BASKET, COUNTS, weights(), scores())
_INSIDE = f"inside AS (SELECT * FROM art WHERE date_key BETWEEN {LOW} AND {HIGH})"
ORACLE["retrieve_dated"] = sql(RANKED.format(where=OTHERS, limit=500), BASKET, DATED, weights(), _INSIDE, scores(docs="inside"))
ORACLE["retrieve_threshold"] = sql(f"SELECT pmid, score FROM scr WHERE score >= {LEAST_SCORE}", BASKET, COUNTS, weights("bgfreq"), scores())
ORACLE["score_inputs"] = sql("SELECT pmid, score FROM scr WHERE pmid IN (SELECT pmid FROM relevant)", BASKET, COUNTS, weights(), scores())
_METHODS = ("laplace", "laplace_split", "bgfreq", "rubin")
ORACLE["param_sweep"] = sql(
    "SELECT config, CAST(rank AS INTEGER) AS rank, pmid, score FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY score DESC, pmid DESC) AS rank FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS config, * FROM scr_{m}" for m in _METHODS) + ")) WHERE rank <= 100",
    BASKET, COUNTS, *(weights(m, name=f"_{m}") for m in _METHODS), *(scores(f"_{m}") for m in _METHODS),
)
ORACLE["id_status"] = sql(
    """SELECT i.pmid, CASE WHEN art.pmid IS NULL THEN 'broken' WHEN relevant.pmid IS NOT NULL THEN 'excluded' ELSE 'ok' END AS status
    FROM (SELECT pmid FROM art UNION ALL SELECT pmid + 1000000000 FROM art WHERE (pmid + 1000000000) % 3 = 0) i LEFT JOIN art USING (pmid) LEFT JOIN relevant USING (pmid)""",
    BASKET,
)
ORACLE["random_negatives"] = sql(f"SELECT pmid FROM art WHERE pmid NOT IN (SELECT pmid FROM relevant) ORDER BY md5('{SEED}|' || pmid), pmid LIMIT 200", BASKET)
_VACUUM = "least AS (SELECT greatest(1, count(*) // 10) AS k FROM art), kept AS (SELECT fid AS old, CAST(row_number() OVER (ORDER BY fid) - 1 AS INTEGER) AS new FROM vocab, least WHERE df >= k)"
ORACLE["vacuum_map"] = sql("SELECT fid AS old, coalesce(new, -1) AS new FROM vocab LEFT JOIN kept ON fid = old", BASKET, _VACUUM)
ORACLE["vacuum_vectors"] = sql(f"SELECT pmid, date_key, coalesce(features, '') AS features FROM art LEFT JOIN ({vector('ids JOIN kept ON fid = old', 'new')}) USING (pmid)", BASKET, _VACUUM)
ORACLE["incremental_df"] = sql(
    f""", first AS (SELECT row_number() OVER (ORDER BY ftype, fname) AS fid, ftype, fname, df FROM (SELECT ftype, fname, count(*) AS df FROM long JOIN art USING (pmid) WHERE date_key < {LATER} GROUP BY ftype, fname)),
    more AS (SELECT ftype, fname, count(*) AS k FROM long JOIN art USING (pmid) WHERE date_key >= {LATER} GROUP BY ftype, fname)
    SELECT CAST(fid AS INTEGER) AS fid, ftype, fname, df + coalesce(k, 0) AS df FROM first LEFT JOIN more USING (ftype, fname)
    UNION ALL SELECT CAST((SELECT count(*) FROM first) + row_number() OVER (ORDER BY ftype, fname) AS INTEGER), ftype, fname, k FROM more ANTI JOIN first USING (ftype, fname)""",
    BASKET,
)
FOLLOW = """SELECT rank, pmid, CAST(tp AS BIGINT) AS tp, round(CAST(tp AS DOUBLE) / rank, 6) AS precision, round(CAST(tp AS DOUBLE) / (SELECT count(*) FROM {known}), 6) AS recall
FROM (SELECT *, sum(CASE WHEN pmid IN (SELECT pmid FROM {known}) THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS tp FROM ({ranked}))"""
ORACLE["tp_vs_rank"] = sql(FOLLOW.format(known="relevant", ranked=RANKED.format(where="", limit=1000)), BASKET, COUNTS, weights(), scores())
ORACLE["retrieval_test"] = sql(
    FOLLOW.format(known="test", ranked=RANKED.format(where=" WHERE pmid NOT IN (SELECT pmid FROM older)", limit="(SELECT count(*) + 100 FROM test)")),
    BASKET, "older AS (SELECT pmid FROM relevant JOIN art USING (pmid) WHERE date_key < 19980101), test AS (SELECT pmid FROM relevant JOIN art USING (pmid) WHERE date_key BETWEEN 19980101 AND 19981231)",
    DATED.replace(str(LOW), "19980101").replace(str(HIGH), "19981231").replace("relevant", "older"), weights(), "inside AS (SELECT * FROM art WHERE date_key BETWEEN 19980101 AND 19981231)", scores(docs="inside"),
)
ORACLE["lookup_vectors"] = sql(f"SELECT pmid, date_key, CAST(coalesce(n, 0) AS INTEGER) AS n FROM art JOIN relevant USING (pmid) LEFT JOIN ({vector('ids')}) USING (pmid)", BASKET)

# ---- metrics of the basket's scores

LABELLED = f"lab AS (SELECT pmid, CASE WHEN pmid IN (SELECT pmid FROM relevant) THEN 1 ELSE 0 END AS label, pmid % {FOLDS} AS fold, round(coalesce(own, 0.0) + base + prior, 3) AS score FROM art LEFT JOIN own USING (pmid), mdl)"
CURVE = """
ties AS (SELECT score, count(*) FILTER (label = 1) AS pe, count(*) FILTER (label <> 1) AS ne FROM lab GROUP BY score),
crv AS (SELECT score, pe, ne, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n - fp AS BIGINT) AS tn, CAST(p - tp AS BIGINT) AS fn FROM (
  SELECT *, sum(pe) OVER (ORDER BY score DESC) AS tp, sum(ne) OVER (ORDER BY score DESC) AS fp, sum(pe) OVER () AS p, sum(ne) OVER () AS n FROM ties))"""


def ratios(alpha: float = 0.5) -> str:
    return f"""
rat AS (SELECT *, CASE WHEN tpr > 0 AND ppv > 0 THEN 2 * tpr * ppv / (tpr + ppv) ELSE 0.0 END AS fm, CASE WHEN tpr > 0 AND ppv > 0 THEN 1 / ({alpha} / ppv + (1 - {alpha}) / tpr) ELSE 0.0 END AS fma FROM (
  SELECT *, CAST(tp AS DOUBLE) / (tp + fn) AS tpr, CAST(fp AS DOUBLE) / (fp + tn) AS fpr, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS ppv,
    (CAST(fp + tn AS DOUBLE) / (tp + fn) * tp - fp) / (CAST(fp + tn AS DOUBLE) / (tp + fn) * (tp + fn)) AS u FROM crv))"""


def scored(select: str, *more: str) -> str:
    return sql(select, BASKET, COUNTS, weights(), scores(), LABELLED, CURVE, *more)


ORACLE["confusion_curve"] = scored("SELECT * FROM crv")
ORACLE["metric_curve"] = scored("SELECT score, pe, ne, tp, fp, tn, fn, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("tpr", "fpr", "ppv", "u", "fm", "fma")) + " FROM rat", ratios(0.3))
ORACLE["roc_area_se"] = scored(
    """SELECT round(w, 6) AS w, round(q1, 6) AS q1, round(q2, 6) AS q2, round(sqrt((w * (1 - w) + (p - 1) * (q1 - w * w) + (n - 1) * (q2 - w * w)) / (p * n)), 6) AS w_stderr, round(roc, 6) AS roc_area, round(pr, 6) AS pr_area
    FROM (SELECT p, n, sum(ne * (tp - pe) + 0.5 * ne * pe) / (n * p) AS w, sum(pe * (tn * tn + tn * ne + ne * ne / 3)) / (p * n * n) AS q2, sum(ne * ((tp - pe) * (tp - pe) + (tp - pe) * pe + pe * pe / 3)) / (n * p * p) AS q1
      FROM (SELECT CAST(pe AS DOUBLE) AS pe, CAST(ne AS DOUBLE) AS ne, CAST(tp AS DOUBLE) AS tp, CAST(tn AS DOUBLE) AS tn, CAST(sum(pe) OVER () AS DOUBLE) AS p, CAST(sum(ne) OVER () AS DOUBLE) AS n FROM crv) GROUP BY p, n),
    (SELECT sum((fpr - fpr0) * (tpr + tpr0) / 2) AS roc, sum((tpr - tpr0) * (ppv + ppv0) / 2) AS pr FROM (SELECT *, lag(tpr) OVER o AS tpr0, lag(fpr) OVER o AS fpr0, lag(ppv) OVER o AS ppv0 FROM rat WINDOW o AS (ORDER BY score DESC)))""",
    ratios(),
)
ORACLE["avg_precision"] = scored("SELECT round(avg(CAST(tp AS DOUBLE) / r), 9) AS avprec FROM (SELECT label, row_number() OVER o AS r, sum(label) OVER o AS tp FROM lab WINDOW o AS (ORDER BY score DESC, label DESC, pmid ROWS UNBOUNDED PRECEDING)) WHERE label = 1")
ORACLE["breakeven"] = scored("SELECT score, round((tpr + ppv) / 2, 6) AS breakeven FROM rat ORDER BY round(abs(tpr - ppv), 9), score LIMIT 1", ratios())
ORACLE["precision_11"] = scored("SELECT k / 10.0::DOUBLE AS recall, round(coalesce((SELECT max(ppv) FROM rat WHERE tpr >= k / 10.0::DOUBLE - 1e-12), 0.0), 6) AS precision FROM range(11) t(k)", ratios())
_PERFORMANCE = """
base_ AS (SELECT *, tp + fn AS p, tn + fp AS n, tp + tn + fp + fn AS a, tp + tn AS t, fp + fn AS f FROM mat),
rates AS (SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS tpr, CASE WHEN p > 0 THEN fn / p ELSE 0 END AS fnr, CASE WHEN n > 0 THEN tn / n ELSE 0 END AS tnr, CASE WHEN n > 0 THEN fp / n ELSE 0 END AS fpr,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS ppv, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 1 END AS npv, t / a AS accuracy, p / a AS prevalence, CASE WHEN tp > 0 THEN fp / tp ELSE 0 END AS fp_tp_ratio FROM base_),
perf AS (SELECT *, 1 - ppv AS fdr, 1 - accuracy AS error, CASE WHEN prevalence > 0 THEN ppv / prevalence ELSE 0 END AS enrichment, (ur * tp - fp) / (ur * p) AS utility,
  CASE WHEN tpr > 0 AND ppv > 0 THEN 2 * tpr * ppv / (tpr + ppv) ELSE 0 END AS fmeasure, CASE WHEN tpr > 0 AND ppv > 0 THEN 1 / ({alpha} / ppv + (1 - {alpha}) / tpr) ELSE 0 END AS fmeasure_alpha FROM rates)"""
_METRICS = ("tp", "tn", "fp", "fn", "p", "n", "a", "t", "f", "tpr", "fnr", "tnr", "fpr", "ppv", "npv", "accuracy", "prevalence", "fp_tp_ratio", "fdr", "error", "enrichment", "utility", "fmeasure", "fmeasure_alpha")
_AT = f"""mat AS (SELECT score, CAST(tp AS DOUBLE) AS tp, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(fp + tn AS DOUBLE) / (tp + fn) AS ur FROM crv
  WHERE score = (SELECT coalesce(min(score) FILTER (score >= {LEAST_SCORE}), max(score)) FROM crv))"""
ORACLE["threshold_metrics"] = scored("SELECT score, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in _METRICS) + " FROM perf", _AT, _PERFORMANCE.format(alpha=0.3))
ORACLE["best_threshold"] = scored("SELECT score, round(fma, 6) AS fma FROM rat ORDER BY round(fma, 9) DESC, score LIMIT 1", ratios(0.3))


def fold_ranges(least: str) -> str:
    """Pooled values and extremes over folds of all metrics, at a threshold."""
    by_fold = f"""bar AS (SELECT {least} AS least FROM crv),
matrices AS (SELECT fold, CAST(count(*) FILTER (label = 1 AND score >= least) AS DOUBLE) AS tp, CAST(count(*) FILTER (label <> 1 AND score < least) AS DOUBLE) AS tn,
  CAST(count(*) FILTER (label <> 1 AND score >= least) AS DOUBLE) AS fp, CAST(count(*) FILTER (label = 1 AND score < least) AS DOUBLE) AS fn FROM lab, bar GROUP BY GROUPING SETS ((fold), ())),
mat AS (SELECT *, (SELECT (fp + tn) / (tp + fn) FROM matrices WHERE fold IS NULL) AS ur FROM matrices)"""
    return scored(
        "SELECT metric, round(max(value) FILTER (fold IS NULL), 6) + 0.0 AS average, round(min(value), 6) + 0.0 AS minimum, round(max(value), 6) + 0.0 AS maximum FROM ("
        + " UNION ALL ".join(f"SELECT '{m}' AS metric, fold, CAST({m} AS DOUBLE) AS value FROM perf" for m in _METRICS) + ") GROUP BY metric",
        by_fold, _PERFORMANCE.format(alpha=0.5),
    )


ORACLE["fold_range"] = fold_ranges(f"any_value({LEAST_SCORE})")


def binned(values: str, density: bool, empty: str) -> tuple[str, str]:
    shape = f"""
srt AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS spot, count(*) OVER () AS n FROM ({values})),
qrt AS (SELECT any_value(n) AS n, min(v) AS least, max(v) AS most, max(v) FILTER (spot = (3 * n) // 4) - max(v) FILTER (spot = n // 4) AS iqr FROM srt),
shp AS (SELECT *, CAST(CASE WHEN iqr = 0 THEN 150 ELSE least(150, greatest(10, floor((most - least) / (2 * iqr * pow(n, -1.0 / 3))))) END AS INTEGER) AS bins FROM qrt),
put AS (SELECT CAST(least(bins - 1, CASE WHEN most = least THEN 0 ELSE floor((v - least) / ((most - least) / bins)) END) AS INTEGER) AS bin, count(*) AS k FROM srt, shp GROUP BY ALL)"""
    mass = "coalesce(k, 0) / (n * ((most - least) / bins))" if density else "CAST(coalesce(k, 0) AS DOUBLE)"
    return shape, f"""SELECT CAST(b AS INTEGER) AS bin, round(least + b * ((most - least) / bins), 6) + 0.0 AS left, coalesce(k, 0) AS count, round(CASE WHEN coalesce(k, 0) = 0 THEN {empty} ELSE {mass} END, 6) + 0.0 AS mass
FROM (SELECT *, unnest(range(bins)) AS b FROM shp) LEFT JOIN put ON bin = b"""


_shape, _bins = binned("SELECT score AS v FROM lab", True, "0.0")
ORACLE["score_histogram"] = scored(_bins, _shape)
_shape, _bins = binned("SELECT round(score, 3) AS v FROM wts WHERE selected AND pos + neg > 0", False, "1.0")
ORACLE["weight_histogram"] = sql(_bins, BASKET, COUNTS, weights(), _shape)
ORACLE["score_density"] = scored(
    """SELECT round(x, 6) AS x, round(sum(k * exp(-((x - v) / h) * ((x - v) / h) / 2) / (n * h * 2.5066282746310002)), 6) AS density
    FROM (SELECT i, lo + (hi - lo) * i / 63 AS x, n, pow(n, -0.2) * sd AS h FROM (SELECT count(*) AS n, stddev_pop(score) AS sd, min(score) AS lo, max(score) AS hi FROM lab), range(64) t(i)), (SELECT score AS v, count(*) AS k FROM lab GROUP BY score)
    GROUP BY i, x"""
)
ORACLE["roc_interpolated"] = scored(
    """SELECT round(x, 6) + 0.0 AS fpr, round(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 6) + 0.0 AS tpr
    FROM (SELECT lo + i * ((hi - lo) / 100) AS x FROM (SELECT min(fpr) AS lo, max(fpr) AS hi FROM rat), range(101) t(i)) g
    ASOF JOIN (SELECT fpr AS x0, tpr AS y0, lead(fpr) OVER (ORDER BY fpr) AS x1, lead(tpr) OVER (ORDER BY fpr) AS y1 FROM (SELECT fpr, max(tpr) AS tpr FROM rat GROUP BY fpr)) p ON g.x + 1e-12 >= p.x0""",
    ratios(),
)

# ---- the text corpus

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in default_stopwords()) + "]"
NO = r"[^\p{L}\p{N}_]"
_SPACE = r"[ \t\n\x0B\f\r]"
ARTICLES = r"""
art AS (SELECT doc_id AS pmid, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS abstract, lang, source, DATE '2000-01-01' + CAST(doc_id % 3650 AS INTEGER) AS day FROM documents)"""
_TEXT = "coalesce(title || ' ', '') || coalesce(abstract, '')"
_FIRST = "split_part(title, ' ', 1)"


def _cap(w: str) -> str:
    return f"CASE WHEN length(upper(substr({w}, 1, 1))) = 1 AND substr({w}, 1, 1) <> 'ß' THEN upper(substr({w}, 1, 1)) || substr({w}, 2) ELSE {w} END"


def _keep(numbers: bool) -> str:
    number = "" if numbers else r" AND NOT regexp_full_match(w, '[0-9eE\W]+')"
    return f"length(w) > 1 AND NOT list_contains({_STOP}, lower(w)){number}"


def split_words(numbers: bool = False, fold: bool = False) -> str:
    text = f"lower({_TEXT})" if fold else _TEXT
    pieces = rf"""string_split_regex({text}, '{_SPACE}|''s|--|[!/<>=#$^"{{}};:&]')"""
    stripped = rf"regexp_replace(regexp_replace(u, '\A{NO}+', ''), '{NO}+\z', '')"
    return f"SELECT DISTINCT pmid, 'w' AS ftype, {'w' if fold else _cap('w')} AS fname FROM (SELECT pmid, {stripped} AS w FROM (SELECT pmid, unnest({pieces}) AS u FROM art)) WHERE {_keep(numbers)}"


_HEADINGS = f"SELECT pmid, 'mesh' AS ftype, lang AS fname FROM art WHERE lang IS NOT NULL UNION SELECT pmid, 'mesh', {_FIRST} FROM art WHERE title IS NOT NULL UNION SELECT pmid, 'qual', source FROM art UNION SELECT pmid, 'issn', source FROM art WHERE source IS NOT NULL"
_AUTHORS = "SELECT pmid, 'a' AS ftype, lower(source || ' ' || lang) AS fname FROM art WHERE source <> '' AND lang <> ''"
_STRIP = f"SELECT DISTINCT pmid, 'w' AS ftype, w AS fname FROM (SELECT pmid, unnest(string_split_regex(lower({_TEXT}), '{NO}+')) AS w FROM art) WHERE length(w) > 1 AND NOT list_contains({_STOP}, w)"


def _raw(text: str) -> str:
    return f"SELECT DISTINCT pmid, 'w' AS ftype, w AS fname FROM (SELECT pmid, unnest(string_split_regex({text}, '{_SPACE}+')) AS w FROM art) WHERE w <> '' AND NOT list_contains({_STOP}, lower(w))"


ORACLE["words_title_case"] = sql(split_words(), ARTICLES)
ORACLE["words_fold"] = sql(split_words(fold=True), ARTICLES)
ORACLE["words_num"] = sql(split_words(numbers=True), ARTICLES)
ORACLE["words_strip"] = sql(_STRIP, ARTICLES)
ORACLE["words_raw"] = sql(_raw("concat_ws(' ', title, abstract)"), ARTICLES)
ORACLE["words_raw_all"] = sql(_raw(f"concat_ws(' ', title, abstract, source, lang, lang, lang, source, {_FIRST})"), ARTICLES)
ORACLE["features_headings"] = sql(_HEADINGS, ARTICLES)
ORACLE["features_authors"] = sql(_AUTHORS, ARTICLES)
_ALL = f"{_HEADINGS} UNION {split_words()} UNION {_AUTHORS}"
ORACLE["features_union"] = sql(_ALL, ARTICLES)
ORACLE["features_filtered"] = sql(
    f"SELECT f.pmid, f.ftype, f.fname FROM ({_ALL}) f JOIN (SELECT pmid, string_split_regex(lower(concat_ws(' ', lang, {_FIRST}, source)), '{NO}+') AS tokens FROM art) t USING (pmid) WHERE NOT (ftype = 'w' AND list_contains(tokens, lower(fname)))", ARTICLES
)
TEXT_CORPUS = f"""
long AS ({_STRIP}),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY ftype, fname) AS INTEGER) AS fid, ftype, fname, df FROM (SELECT ftype, fname, count(*) AS df FROM long GROUP BY ftype, fname HAVING count(*) >= 2)),
ids AS (SELECT pmid, fid FROM long JOIN vocab USING (ftype, fname)),
relevant AS (SELECT doc_id AS pmid FROM labels WHERE toxic = 1)"""
ORACLE["retrieve_text"] = sql("SELECT pmid, round(score, 4) + 0.0 AS score FROM (SELECT * FROM scr WHERE pmid NOT IN (SELECT pmid FROM relevant) AND score >= 0 ORDER BY score DESC, pmid DESC LIMIT 200)", ARTICLES, TEXT_CORPUS, COUNTS, weights(), scores())
_FOLDS = f"folded AS (SELECT doc_id AS pmid, toxic AS label, CAST(ntile({FOLDS}) OVER (PARTITION BY toxic ORDER BY md5('{SEED}|' || doc_id), doc_id) - 1 AS INTEGER) AS fold FROM labels)"
ORACLE["fold_assignment"] = sql("SELECT * FROM folded", _FOLDS)
CV_SELECT = """SELECT pmid, label, fold, round(coalesce(own, 0.0) + base + prior, 4) + 0.0 AS score
    FROM known LEFT JOIN (SELECT pmid, sum(score) AS own FROM known JOIN ids USING (pmid) JOIN wts USING (fold, fid) GROUP BY pmid) USING (pmid) JOIN (SELECT fold, sum(absent) AS base FROM wts GROUP BY fold) USING (fold), (SELECT ln(CAST(p AS DOUBLE) / n) AS prior FROM whole)"""
CV = """known AS (SELECT folded.* FROM folded JOIN art USING (pmid)),
    size_ AS (SELECT fold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM known GROUP BY fold),
    whole AS (SELECT CAST(sum(p) AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS n FROM size_),
    occ AS (SELECT fold, fid, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM known JOIN ids USING (pmid) GROUP BY fold, fid),
    alls AS (SELECT fid, sum(p) AS p, sum(n) AS n FROM occ GROUP BY fid),
    grid AS (SELECT s.fold, v.fid, CAST(coalesce(a.p, 0) - coalesce(o.p, 0) AS DOUBLE) AS pos, CAST(coalesce(a.n, 0) - coalesce(o.n, 0) AS DOUBLE) AS neg, CAST(w.p - s.p AS DOUBLE) AS pd, CAST(w.n - s.n AS DOUBLE) AS nd
      FROM vocab v CROSS JOIN size_ s CROSS JOIN whole w LEFT JOIN alls a ON a.fid = v.fid LEFT JOIN occ o ON o.fid = v.fid AND o.fold = s.fold),
    fr AS (SELECT *, (2 * pi + pos) / (4 * pi + pd) AS pf, (2 * (1 - pi) + neg) / (4 * (1 - pi) + nd) AS nf FROM (SELECT *, (pd + 1) / (pd + nd + 2) AS pi FROM grid WHERE pos + neg >= 2)),
    wts AS (SELECT fold, fid, ln(1 - pf) - ln(1 - nf) AS absent, ln(pf) - ln(nf) - (ln(1 - pf) - ln(1 - nf)) AS score FROM fr)"""
ORACLE["cv_scores"] = sql(CV_SELECT, ARTICLES, TEXT_CORPUS, _FOLDS, CV)

# ---- result tables

RESULTS = r"""
lst AS (SELECT row_number() OVER (ORDER BY score DESC, pmid DESC) AS rank, * FROM (SELECT *, round(100 - pmid % 997 / 10.0::DOUBLE, 2) AS score FROM art)),
res AS (SELECT CAST(rank AS INTEGER) AS rank, pmid, score, printf('%.2f', score) AS shown_score, strftime(day, '%Y.%m.%d') AS date, concat_ws(' ', source, lang) || ', ' || lang || ', X ' AS authors, source AS journal, title, abstract FROM lst)"""
ORACLE["browse_filter"] = sql(
    """SELECT pmid, rank, score >= 20 AND date BETWEEN '2001.01.01' AND '2008.06.30' AND regexp_matches(t, 'an', 'i') AND NOT regexp_matches(t, 'qu[ae]', 'i') AND regexp_matches(journal, 'SRC1', 'i') AND regexp_matches(authors, 'src1[0-9] (en|de)', 'i') AS visible
    FROM (SELECT *, coalesce(title, '') || ' ' || coalesce(abstract, '') AS t FROM res)""",
    ARTICLES, RESULTS,
)
ORACLE["browse_sort"] = sql(
    r"""SELECT CAST(row_number() OVER (ORDER BY nullif(regexp_extract(split_part(authors, ',', 1), '(\S+)\s*$', 1), '') NULLS LAST, date DESC, rank) AS INTEGER) AS place, rank, pmid, shown_score, date, authors, journal FROM res""", ARTICLES, RESULTS
)
_PAGES = "pgd AS (SELECT *, CAST(least((rank - 1) // 64, greatest(1, (n + 63) // 64 - CASE WHEN n % 64 <> 0 AND n % 64 < 32 THEN 1 ELSE 0 END) - 1) AS INTEGER) AS page FROM (SELECT *, count(*) OVER () AS n FROM res))"
ORACLE["result_pages"] = sql("SELECT pmid, rank, page FROM pgd", ARTICLES, RESULTS, _PAGES)
ORACLE["page_ids"] = sql("SELECT string_agg(CAST(pmid AS VARCHAR), ',' ORDER BY rank) AS ids FROM pgd WHERE page = 1", ARTICLES, RESULTS, _PAGES)
ORACLE["tag_lines"] = sql("SELECT pmid, score, CASE WHEN pmid % 3 < 2 THEN CAST(pmid % 3 AS INTEGER) END AS tag FROM res", ARTICLES, RESULTS)
ORACLE["score_lines"] = sql("SELECT printf('%-10d %f', pmid, score) AS value FROM (" + RANKED.format(where=OTHERS, limit=200) + ")", BASKET, COUNTS, weights(), scores())

# ---- co-occurrence

TEXTS = r"""
txt AS (SELECT pmid AS text_id, concat_ws(' ', nullif(CASE WHEN coalesce(title, '') = '' OR title LIKE '%.' THEN coalesce(title, '') ELSE title || '.' END, ''), abstract) AS text FROM art)"""
# a sentence ends after a word whose last sign and next word say so: words with the white space behind them, numbered and grouped
_TITLES = "Rev|Mr|Dr|Miss|Mrs|Ms|Sr|Prof|Ph"
_WSN = r"\t\n\x0B\f\r "
SENTENCES = rf"""
wrd AS (SELECT text_id, unnest(w) AS piece, generate_subscripts(w, 1) AS k FROM (SELECT text_id, regexp_extract_all(replace(text, chr(10), ' '), '[^{_WSN}]+[{_WSN}]*|[{_WSN}]+') AS w FROM txt)),
lst AS (SELECT *, regexp_extract(piece, '^[^{_WSN}]*') AS body, coalesce(lead(left(piece, 1)) OVER (PARTITION BY text_id ORDER BY k), '') AS ahead FROM wrd),
ends AS (SELECT *, length(body) < length(piece) AND (body SIMILAR TO '.*[!?]' OR (length(regexp_extract(body, '[.]*$')) % 3 > 0 AND NOT body SIMILAR TO '.*({_TITLES})[.]' AND NOT ahead BETWEEN 'a' AND 'z')) AS over FROM lst),
grp AS (SELECT text_id, k, piece, coalesce(sum(CASE WHEN over THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number FROM ends
  UNION ALL SELECT text_id, 1 + coalesce(max(k), 0), '', coalesce(sum(CASE WHEN over THEN 1 ELSE 0 END), 0) FROM (SELECT text_id, 0 AS k, false AS over FROM txt WHERE text IS NOT NULL UNION ALL SELECT text_id, k, over FROM ends) GROUP BY text_id),
cut AS (SELECT text_id, number, string_agg(piece, '' ORDER BY k) AS s FROM grp GROUP BY text_id, number),
sen AS (SELECT text_id, CAST(number AS INTEGER) AS number, s AS sentence, CAST(e - length(s) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM (SELECT *, sum(length(s)) OVER (PARTITION BY text_id ORDER BY number) AS e FROM cut))"""
ORACLE["sentences"] = sql('SELECT text_id, number, sentence, start, "end" FROM sen', ARTICLES, TEXTS, SENTENCES)


def spans(text: str, pattern: str, name: str, columns: str) -> str:
    """CTE ``name``: start and end of every match, from the pieces between matches."""
    return f"""
{name}_m AS (SELECT text_id, text, unnest(m) AS hit, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS spot FROM (SELECT text_id, text, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM txt)),
{name} AS (SELECT text_id, {columns}, CAST(e - length(hit) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", substr(text, CAST(e - length(hit) + 1 AS BIGINT), length(hit)) AS surface FROM (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY text_id ORDER BY spot) AS e FROM {name}_m))"""


def pattern_of(aliases) -> str:
    import re

    kept = dict.fromkeys(re.sub("[^a-z]+", " ", a.lower()).strip().replace(" ", r"\s+") for a in aliases)
    return r"\b(?:" + "|".join(a for a in kept if len(a) > 3) + r")\b"


_PLAIN = "regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g')"
_DRUG_CTES = [spans(_PLAIN, pattern_of(a), f"drug{k}", f"'{i}' AS drug_id, '{n}' AS name") for k, (i, n, a) in enumerate(DRUGS)]
_DRUGS = "drg AS (" + " UNION ALL ".join(f"SELECT * FROM drug{k}" for k in range(len(DRUGS))) + ")"
ORACLE["term_spans"] = sql('SELECT text_id, drug_id, name, surface, start, "end" FROM drg', ARTICLES, TEXTS, *_DRUG_CTES, _DRUGS)
_FOUND = """
gen AS (SELECT text_id, surface AS gene, start, "end" FROM gens WHERE (text_id + start) % 5 <> 0),
fre AS (SELECT * FROM gen g WHERE NOT EXISTS (SELECT 1 FROM drg d WHERE d.text_id = g.text_id AND g.start < d."end" AND g."end" >= d.start)),
fnd AS (SELECT DISTINCT s.text_id, d.name AS drug, g.gene FROM sen s JOIN drg d ON d.text_id = s.text_id AND d.start >= s.start AND d."end" <= s."end" JOIN fre g ON g.text_id = s.text_id AND g.start >= s.start AND g."end" <= s."end")"""
CO = (ARTICLES, TEXTS, SENTENCES, *_DRUG_CTES, _DRUGS, spans("text", "(?:" + "|".join(GENES) + ")", "gens", "1 AS one"), _FOUND)
ORACLE["cooccurrences"] = sql("SELECT text_id, drug, string_agg(gene, ' ' ORDER BY gene) AS genes FROM fnd GROUP BY text_id, drug", *CO)
ORACLE["cooccurrence_pairs"] = sql("SELECT gene, drug, count(*) AS n FROM fnd GROUP BY gene, drug", *CO)
ORACLE["pair_articles"] = sql('SELECT text_id AS "PMID", gene AS "GENE", drug AS "DRUG" FROM fnd', *CO)
NUMBERED = "num AS (SELECT CAST(row_number() OVER (ORDER BY gene, drug) - 1 AS INTEGER) AS id, gene, drug, count(*) AS numarticles FROM fnd GROUP BY gene, drug)"
ORACLE["export_genedrug"] = sql("SELECT * FROM num", *CO, NUMBERED)
ORACLE["export_dg_pmids"] = sql("SELECT CAST(text_id AS VARCHAR) AS pmid, id AS dg_id FROM fnd JOIN num USING (gene, drug)", *CO, NUMBERED)
ORACLE["export_star"] = sql(
    """SELECT CAST(pmid AS VARCHAR) AS pmid, title, CASE WHEN abstract <> '' THEN substr(abstract, 1, 2450) END AS abs, genes, drugs
    FROM art JOIN (SELECT text_id AS pmid, string_agg(DISTINCT gene, ' ' ORDER BY gene) AS genes, string_agg(DISTINCT drug, ' ' ORDER BY drug) AS drugs FROM fnd GROUP BY text_id) USING (pmid)""",
    *CO,
)
ORACLE["event_counts"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"
