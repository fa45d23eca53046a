"""Metrics on the golden scores and against brute force."""

import random

import numpy as np
import pytest

from gleaner.operators import metrics as M

#: Scores of two classes, and below what must come out of them. (Fixed values.)
POS, NEG = (1, 2, 3, 4, 4, 5, 5), (0, 0, 1, 1, 2, 4, 5)


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, 1, float(s), i % 2) for i, s in enumerate(POS)] + [(100 + i, 0, float(s), i % 2) for i, s in enumerate(NEG)]
    return spark.createDataFrame(rows, "pmid long, label int, score double, fold int").cache()


def test_curve(golden):
    rows = M.ratio_curve(M.confusion_curve(golden)).orderBy("score").collect()
    table = [(r.score, r.tp, r.tn, r.fp, r.fn, r.pe, r.ne) for r in rows]
    assert table == [(0, 7, 0, 7, 0, 0, 2), (1, 7, 2, 5, 0, 1, 2), (2, 6, 4, 3, 1, 1, 1), (3, 5, 5, 2, 2, 1, 0), (4, 4, 5, 2, 3, 2, 1), (5, 2, 6, 1, 5, 2, 1)]
    assert [r.fm for r in rows] == pytest.approx([0.666667, 0.736842, 0.75, 0.714286, 0.615385, 0.4], abs=1e-6)
    assert [r.u for r in rows] == pytest.approx([0, 0.285714, 0.428571, 0.428571, 0.285714, 0.142857], abs=1e-6)
    assert [r.ppv for r in rows] == pytest.approx([0.5, 0.583333, 0.666667, 0.714286, 0.666667, 0.666667], abs=1e-6)


def test_areas(golden):
    curve = M.confusion_curve(golden)
    areas = M.curve_areas(M.ratio_curve(curve)).first()
    assert (areas.roc_area, areas.pr_area) == pytest.approx((0.724490, 0.477041), abs=1e-6)
    e = M.roc_error(curve).first()
    assert (e.w, e.q1, e.q2, e.w_stderr) == pytest.approx((0.744898, 0.652089, 0.583090, 0.138699), abs=1e-6)
    assert M.averaged_precision(golden).first().avprec == pytest.approx(0.816327, abs=1e-6)


def test_points(golden):
    ratios = M.ratio_curve(M.confusion_curve(golden))
    b = M.breakeven(ratios).first()
    assert (b.score, b.breakeven) == (3, pytest.approx(0.714286, abs=1e-6))
    assert M.threshold_maximising(ratios, "fm").first().score == 2
    got = [r.precision for r in M.precision_11(ratios).orderBy("recall").collect()]
    assert got == pytest.approx([0.714286] * 8 + [0.666667] + [0.583333] * 2, abs=1e-6)
    assert M.index_for(ratios, 2.5).first().score == 3 and M.index_for(ratios, 9).first().score == 5
    assert M.operating_point(golden, 2.5).first().score == 3 and M.operating_point(golden, None).first().score == 2
    assert M.summary(golden, 2.5).first().tp == 5


def test_wilcoxon_is_a_pair_count(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.3), round(rng.gauss(0, 1), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "pmid long, label int, score double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    w = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert M.roc_error(M.confusion_curve(df)).first().w == pytest.approx(w)
    ranked = sorted(rows, key=lambda r: (-r[2], -r[1]))
    hits = [k for k, r in enumerate(ranked, 1) if r[1]]
    assert M.averaged_precision(df).first().avprec == pytest.approx(np.mean([(i + 1) / k for i, k in enumerate(hits)]))


def test_performance_and_range(spark, golden):
    m = M.performance(M.matrix_at(golden, 3.0)).first()
    assert (m.tp, m.tn, m.fp, m.fn) == (5, 5, 2, 2) and m.accuracy == pytest.approx(10 / 14) and m.enrichment == pytest.approx((5 / 7) / 0.5)
    none = M.performance(spark.createDataFrame([(0, 0, 0, 0)], "tp long, tn long, fp long, fn long")).first()
    assert (none.ppv, none.npv, none.tpr, none.accuracy, none.utility) == (1, 1, 0, 0, None)
    got = {r.metric: r for r in M.performance_range(golden, 3.0).collect()}
    per = [sum(1 for i, s in enumerate(POS) if s >= 3 and i % 2 == f) for f in (0, 1)]
    assert (got["tp"].average, got["tp"].minimum, got["tp"].maximum) == (5, min(per), 5)
    assert got["tpr"].minimum <= got["tpr"].average <= got["tpr"].maximum


def test_histogram_and_density(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=400), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "score double")
    s = np.sort(x)
    bins = int(min(150, max(10, (s[-1] - s[0]) // (2 * (s[3 * 400 // 4] - s[400 // 4]) * 400 ** (-1 / 3)))))
    rows = M.histogram(df).orderBy("bin").collect()
    y, edges = np.histogram(x, bins=bins, density=True)
    assert len(rows) == bins and [r.mass for r in rows] == pytest.approx(list(y)) and [r.left for r in rows] == pytest.approx(list(edges[:-1]))
    d = M.kernel_density(df, points=16).orderBy("x").collect()
    h = 400**-0.2 * x.std()
    assert [r.density for r in d] == pytest.approx([np.mean(np.exp(-(((r.x - x) / h) ** 2) / 2)) / h / np.sqrt(2 * np.pi) for r in d])
    same = spark.createDataFrame([(1.0,)] * 5, "score double")
    assert sum(r["count"] for r in M.histogram(same).collect()) == 5


def test_interpolation(spark):
    xs = np.sort(np.random.default_rng(0).random(200))
    ys = np.sin(xs * 3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys, strict=True)], "x double, y double")
    got = sorted((r.x, r.y) for r in M.interpolated(df, "x", "y", 50, 100).collect())
    grid = np.linspace(xs[0], xs[-1], 50)
    assert [g[0] for g in got] == pytest.approx(list(grid)) and [g[1] for g in got] == pytest.approx(list(np.interp(grid, xs, ys)))
    assert M.interpolated(df, "x", "y", 50, 1000).count() == 200


def plain_bins(v):
    """(least, most, bins, counts) of a list."""
    v, n = sorted(v), len(v)
    iqr = v[3 * n // 4] - v[n // 4]
    bins = 150 if iqr == 0 else int(min(150, max(10, (v[-1] - v[0]) // (2 * iqr * n ** (-1 / 3)))))
    width = (v[-1] - v[0]) / bins
    counts = [0] * bins
    for x in v:
        counts[min(bins - 1, int((x - v[0]) / width) if width else 0)] += 1
    return v[0], v[-1], bins, counts


def test_histograms_of_many_groups(spark):
    """One plan for all groups; a group may hold most rows, another one value only, a third is null."""
    rng = random.Random(1)
    rows = [(7, float(rng.randrange(400)) / 4) for _ in range(4000)] + [(g % 500, float(rng.randrange(50))) for g in range(6000)] + [(None, 1.0), (None, 2.0), (900, 5.0), (900, 5.0), (901, None)]
    df = spark.createDataFrame(rows, "g int, score double")
    got = {}
    for r in M.histogram(df, by=("g",), density=False).collect():
        got.setdefault(r.g, {})[r.bin] = (r["count"], r.left)
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, v in groups.items():
        least, most, bins, counts = plain_bins(v)
        assert [got[g][b][0] for b in range(bins)] == counts and len(got[g]) == bins
        assert got[g][bins - 1][1] == pytest.approx(least + (bins - 1) * (most - least) / bins)


def test_ten_thousand_histograms(spark):
    df = spark.range(40_000).selectExpr("id % 10000 AS g", "CAST(id AS DOUBLE) AS score")
    got = M.histogram(df, by=("g",))
    assert got.count() == 100_000 and got.agg({"count": "sum"}).first()[0] == 40_000


def test_density_meets_only_what_a_kernel_reaches(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=3000), [50.0, -30.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "score double")
    got = M.kernel_density(df, points=512).orderBy("x").collect()
    h = len(v) ** -0.2 * v.std()
    grid = np.linspace(v.min(), v.max(), 512)
    want = np.exp(-(((grid[:, None] - v[None]) / h) ** 2) / 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert [r.x for r in got] == pytest.approx(grid.tolist()) and [r.density for r in got] == pytest.approx(want.tolist(), abs=1e-9)
    assert M.kernel_density(spark.createDataFrame([(1.0,)] * 4, "score double")).count() == 0
    assert M.kernel_density(df.limit(0)).count() == 0

