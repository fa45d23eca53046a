"""Index, training, retrieval and cross-validation on the golden inputs."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.config import Params, Task
from gleaner.operators import index, model, order, retrieve, sweep, validate
from gleaner.plans.catalog import QUERIES

#: The toy documents, and below the numbers that must come out of them. (Fixed values.)
FEATURES = "ABDCE"
TOY = {1: "ABD", 2: "AB", 3: "AC", 4: "BAE", 5: "BA", 6: "BC"}


@pytest.fixture(scope="module")
def toy(spark):
    """(vectors, vocabulary, positives): ids by first appearance."""
    docs = spark.createDataFrame([(k, 20000101, sorted(FEATURES.index(c) + 1 for c in v)) for k, v in TOY.items()], "pmid long, date_key int, features array<int>")
    df = {c: sum(c in v for v in TOY.values()) for c in FEATURES}
    vocab = spark.createDataFrame([(i + 1, "w", c, df[c]) for i, c in enumerate(FEATURES)], "fid int, ftype string, fname string, df long")
    return docs, vocab, spark.createDataFrame([(k,) for k in (1, 2, 3)], "pmid long")


def by_name(m, column):
    return [dict((r.fname, r[column]) for r in m.weights.collect())[c] for c in "ABDCE"]


@pytest.mark.parametrize(("method", "expected"), [
    ("laplace_split", [0.980829, -0.980829, 0.980829, 0, -0.980829]), ("laplace", [0.980829, -0.980829, 0.980829, 0, -0.980829]),
    ("bgfreq", [2.248191, -2.248191, 2.248191, 0, -2.248191]), ("rubin", [0.405465, -0.405465, 17.322068, 0, -17.322068]),
])
def test_weights(toy, method, expected):
    m = retrieve.learn(*toy, Params(method=method))
    assert by_name(m, "score") == pytest.approx(expected, abs=1e-6)
    scalars = m.scalars.first()
    assert scalars.base == pytest.approx(0, abs=1e-9) and (scalars.pdocs, scalars.ndocs) == (3, 3) and scalars.prior == pytest.approx(0)


def test_infogain(spark, toy):
    assert by_name(retrieve.learn(*toy), "infogain") == pytest.approx([0.190875, 0.190875, 0.190875, 0, 0.190875], abs=1e-6)
    skewed = spark.createDataFrame([(44, 21, 67, 100000)], "pos long, neg long, pdocs long, ndocs long").select(model.infogain().alias("x")).first().x
    assert skewed == pytest.approx(0.5390937, abs=1e-6)
    none = spark.createDataFrame([(0, 0, 0, 10)], "pos long, neg long, pdocs long, ndocs long").select(model.infogain().alias("x")).first().x
    assert none == 0


def test_selection_stats_tfidf(toy):
    stats = model.feature_stats(retrieve.learn(*toy, Params(mincount=2))).first()
    assert (stats.pos_distinct, stats.pos_occurrences, stats.feats_selected, stats.feats_in_data) == (3, 6, 3, 5)
    m = retrieve.learn(*toy, Params(mincount=2, min_infogain=0.001))
    got = {r.fname: r.tfidf for r in model.tfidf(m).collect()}
    assert got == pytest.approx({"A": 0.109393, "B": 0.072929}, abs=1e-6)
    assert [r.fname for r in model.top_tfidf(m, 1).collect()] == ["A"]
    assert not [r for r in retrieve.learn(*toy, Params(type_mask=("w",))).weights.collect() if r.selected]
    assert sorted(r.fname for r in retrieve.learn(*toy, Params(positives_only=True)).weights.where("selected").collect()) == list("ABCD")
    table = model.feature_table(m).collect()
    assert [r.term for r in table] == ["A", "B"] and table[0].pos_count == 3


def test_prior(toy):
    assert retrieve.learn(*toy, Params(prior=-4.0)).scalars.first().prior == -4.0
    docs, vocab, positives = toy
    scalars = retrieve.learn(docs, vocab, positives.where("pmid = 1")).scalars.first()
    assert scalars.prior == pytest.approx(math.log(2 / 6))
    empty = retrieve.learn(docs, vocab, positives.where("pmid > 99"))
    assert all(math.isfinite(r.score) for r in empty.weights.collect())


DATED = [(1, 20010101, [4]), (2, 20020101, [0, 1, 2]), (3, 20030101, [0, 2, 3]), (4, 20040101, [0, 1]), (5, 20050101, [1, 2, 3]), (6, 20050101, [1, 140, 145])]


def dated(spark):
    return spark.createDataFrame(DATED, "pmid long, date_key int, features array<int>")


def test_retrieval(spark):
    weights = spark.createDataFrame([(0, 0.1), (1, 5.0), (2, 10.0), (3, -5.0), (4, -6.0)], "fid int, score double")
    scalars = spark.createDataFrame([(5.0, 0.0)], "base double, prior double")
    exclude = spark.createDataFrame([(5,), (8,), (9,)], "pmid long")
    params = Params(limit=5, threshold=0.0, mindate=20020101, maxdate=20050101)
    got = [(r.rank, r.pmid, r.score) for r in retrieve.retrieve(dated(spark), model.Model(weights, scalars), params, exclude).collect()]
    assert got == [(1, 2, 20.1), (2, 4, 10.1), (3, 3, 10.1), (4, 6, 10.0)]
    empty = dated(spark).withColumn("features", F.array().cast("array<int>"))
    assert {r.score for r in retrieve.score(empty, model.Model(weights, scalars)).collect()} == {5.0}
    assert retrieve.ranked(retrieve.score(dated(spark).limit(0), model.Model(weights, scalars))).count() == 0


def test_dated_counts(spark):
    exclude = spark.createDataFrame([(4,), (8,), (9,)], "pmid long")
    rest = model.background_docs(dated(spark), 20020101, 20070101, exclude)
    assert rest.count() == 4
    assert {r.fid: r.n for r in model.count_features(rest).collect()} == {0: 2, 1: 3, 2: 3, 3: 2, 140: 1, 145: 1}


def test_subtraction_is_a_direct_count(toy):
    docs, vocab, positives = toy
    a, ta = model.counts_by_subtraction(docs, vocab, positives)
    b, tb = model.counts_dated(docs, vocab, positives)
    key = lambda df: sorted((r.fid, r.pos, r.neg) for r in df.collect())
    assert key(a) == key(b) and ta.first() == tb.select(ta.columns).first()


def test_count_features(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [2, 3, 3]), (3, [3, 4])], "pmid long, features array<int>")
    assert {r.fid: r.n for r in model.count_features(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_orders_of_groups(spark):
    """Numbers, runs and sums of several groups, of which one reaches over all partitions, one is null, and ties stay together."""
    rng = random.Random(3)
    rows = [(rng.choice(["big", "big", "big", "a", "b", None]), rng.randrange(50), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    want = {}
    for g, v, k in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(g, []).append((v, k))
    told = order.numbered(df, ["v", "k"], "n", 5, by=["g"])
    assert told.columns == ["g", "v", "k", "n"]
    assert {(r.g, r.k): r.n for r in told.collect()} == {(g, k): 5 + i for g, own in want.items() for i, (_, k) in enumerate(own)}
    sums = order.running(df, ["v", "k"], {"upto": "v"}, by=["g"]).collect()
    assert {(r.g, r.k): r.upto for r in sums} == {(g, k): sum(v for v, _ in own[: i + 1]) for g, own in want.items() for i, (_, k) in enumerate(own)}
    for tiles in (1, 4, 1000):
        sizes = {g: [size for _, size in validate.fold_sizes(len(own), tiles)] for g, own in want.items()}
        got = order.tiled(df, ["v", "k"], "t", tiles, by=["g"]).collect()
        assert {(r.g, r.k): r.t for r in got} == {(g, k): t for g, own in want.items() for (_, k), t in zip(own, [t for t, n in enumerate(sizes[g]) for _ in range(n)], strict=True)}
    assert order.numbered(df.limit(0), ["v"], "n", by=["g"]).count() == 0 and order.tiled(df, ["v", "k"], "t", 3).groupBy("t").count().count() == 3


def plain_cross_validation(spark, docs, vocab, folded, params):
    """A model for each fold, trained on the other folds' counts of every feature."""
    out = {}
    rows = docs.join(folded.select("pmid", "label", "fold"), "pmid").collect()
    features = vocab.collect()
    for fold in {r.fold for r in rows}:
        rest, own = [r for r in rows if r.fold != fold], [r for r in rows if r.fold == fold]
        n = lambda f, label: sum(f in r.features for r in rest if (r.label == 1) == label)  # noqa: E731, B023
        counts = spark.createDataFrame([(f.fid, f.ftype, f.fname, f.df, n(f.fid, True), n(f.fid, False)) for f in features], "fid int, ftype string, fname string, df long, pos long, neg long")
        p = sum(r.label == 1 for r in rows)
        totals = spark.createDataFrame([(sum(r.label == 1 for r in rest), sum(r.label != 1 for r in rest), len(rows), math.log(p / (len(rows) - p)))], "pdocs long, ndocs long, numdocs long, prior double")
        m = model.train(counts, totals, params)
        weights, scalars = {r.fid: r.score for r in m.weights.collect()}, m.scalars.first()
        for r in own:
            out[r.pmid] = scalars.base + scalars.prior + sum(weights[f] for f in set(r.features))
    return out


@pytest.mark.parametrize("params", [Params(), Params(method="bgfreq"), Params(method="rubin"), Params(method="laplace", mincount=2, type_mask=("x",)), Params(min_infogain=0.01, positives_only=True)])
def test_cross_validation_is_a_model_for_each_fold(spark, params):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, 20000101, sorted(rng.sample(range(1, 16), rng.randrange(0, 7)))) for k in range(40)], "pmid long, date_key int, features array<int>")
    vocab = spark.createDataFrame([(f, "x" if f % 5 == 0 else "w", f"n{f}", 30 + f) for f in range(1, 20)], "fid int, ftype string, fname string, df long")
    folded = validate.folds(spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(40)], "pmid long, label int"), 4, 2)
    got = {r.pmid: r.score for r in validate.cross_validate(docs, vocab, folded, params).collect()}
    assert got == pytest.approx(plain_cross_validation(spark, docs, vocab, folded, params), abs=1e-9) and len(got) == 40


def test_samples_are_the_smallest_hashes(spark):
    pool = spark.range(3000).selectExpr("id AS pmid")
    place = lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i)
    for k in (0, 1, 37, 2999, 3000, 5000):
        assert {r.pmid for r in retrieve.random_subset(pool, k, 7).collect()} == set(sorted(range(3000), key=place)[:k])
    some = retrieve.random_subset(pool, 2000, 7)
    # whoever is surely in comes through a filter; only those with the one beginning are sorted
    assert "TakeOrderedAndProject" in some._jdf.queryExecution().executedPlan().toString() and "Union" in some._jdf.queryExecution().executedPlan().toString()


def test_folds(spark):
    assert [s for _, s in validate.fold_sizes(10, 5)] == [2] * 5
    assert validate.fold_sizes(33, 5) == [(0, 7), (7, 7), (14, 7), (21, 6), (27, 6)]
    rows = spark.range(66).select(F.col("id").alias("pmid"), (F.col("id") % 2).cast("int").alias("label"))
    for seed in (0, 3):
        got = validate.folds(rows, 5, seed).groupBy("label", "fold").count().collect()
        assert sorted(r["count"] for r in got) == sorted([7, 7, 7, 6, 6] * 2)


def test_cross_validation(spark):
    vectors = [(1, 1, [1, 2, 3]), (2, 1, [1, 3]), (3, 1, [1, 3]), (4, 1, [1, 3]), (5, 0, [1, 2]), (6, 0, [1, 2]), (7, 0, [1, 2]), (8, 0, [1, 2, 3])]
    docs = spark.createDataFrame([(i, 0, f) for i, _, f in vectors], "pmid long, date_key int, features array<int>")
    vocab = spark.createDataFrame([(1, "w", "a", 8), (2, "w", "b", 5), (3, "w", "c", 5)], "fid int, ftype string, fname string, df long")
    labels = spark.createDataFrame([(i, y) for i, y, _ in vectors], "pmid long, label int")
    got = {r.pmid: r.score for r in validate.cross_validate(docs, vocab, validate.folds(labels, 4, 0)).collect()}
    expected = [-0.693147, 1.791759, 1.791759, 2.484907, -2.484907, -1.791759, -1.791759, 0.693147]
    assert [got[i] for i in range(1, 9)] == pytest.approx(expected, abs=1e-6)


def test_index_grows_and_shrinks(spark):
    long = lambda rows: spark.createDataFrame(rows, "pmid long, ftype string, fname string")
    first = index.vocabulary(long([(1, "Q", "A"), (1, "Q", "B"), (1, "T", "A"), (1, "T", "C")]))
    assert sorted((r.fid, r.df) for r in first.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    more = long([(2, "Q", "B"), (2, "Q", "DØ")])
    both = index.grown(first, more)
    assert sorted((r.fid, r.df) for r in both.collect()) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 1)]
    assert index.grown(first, more, grow=False).count() == 4
    docs = index.vectors(spark.createDataFrame([(2, 0), (3, 0)], "pmid long, date_key int"), more, both)
    assert {r.pmid: r.features for r in docs.collect()} == {2: [2, 5], 3: []}
    less = index.removed(both, docs)
    assert sorted((r.fid, r.df) for r in less.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 0)]
    mapping = index.vacuum_map(less, 1)
    assert {r.old: r.new for r in mapping.collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: -1}
    assert sorted((r.fid, r.df) for r in index.vacuum_vocabulary(less, mapping).collect()) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert {r.pmid: r.features for r in index.vacuum_vectors(docs, mapping).collect()} == {2: [1], 3: []}
    assert index.feature_names(both, spark.createDataFrame([(5,), (99,)], "fid int")).orderBy("fid").collect()[0].fname == "DØ"


def test_index_updates(spark):
    docs = spark.createDataFrame([(1, 19990101, [1, 3]), (2, 20000101, [2, 3, 5434, 3243232]), (3, 20010101, [5, 10, 15])], "pmid long, date_key int, features array<int>")
    change = spark.createDataFrame([(2, 20020101, [5, 6, 7])], docs.schema)
    assert {r.pmid: r.features for r in index.replaced(docs, change).collect()}[2] == [5, 6, 7]
    with pytest.raises(ValueError, match="unique"):
        index.insertable(docs, change)
    fresh = spark.createDataFrame([(9, 1, [1])], docs.schema)
    assert index.insertable(docs, fresh).count() == 1
    vocab = spark.createDataFrame([(1, "w", "x", 1)], "fid int, ftype string, fname string, df long")
    articles = spark.createDataFrame([(3, 5), (4, 6)], "pmid long, date_key int")
    long = spark.createDataFrame([(3, "w", "x"), (4, "w", "x"), (4, "w", "y")], "pmid long, ftype string, fname string")
    grown, bigger = index.added(docs, vocab, articles, long)
    assert {r.pmid: r.features for r in grown.collect()}[4] == [1, 2] and grown.count() == 4
    assert sorted((r.fname, r.df) for r in bigger.collect()) == [("x", 2), ("y", 1)]


def test_ids(spark, tmp_path):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 2)], "pmid long")
    include, exclude = (spark.createDataFrame([(i,) for i in x], "pmid long") for x in ((1, 2, 3, 4), (1,)))
    got = sorted((r.pmid, r.status) for r in retrieve.id_status(ids, include, exclude).collect())
    assert got == [(1, "excluded"), (2, "ok"), (2, "ok"), (3, "ok"), (4, "ok"), (5, "broken")]
    assert retrieve.valid_ids(retrieve.id_status(ids, include)).count() == 5
    with pytest.raises(retrieve.NoValidIds) as e:
        retrieve.valid_ids(retrieve.id_status(ids, include.where("pmid > 9")))
    assert sorted({r.pmid for r in e.value.broken.collect()}) == [1, 2, 3, 4, 5]
    pool = spark.range(100).withColumnRenamed("id", "pmid")
    sample = [r.pmid for r in retrieve.random_subset(pool, 10, 5, include).collect()]
    assert len(set(sample)) == 10 and not set(sample) & {1, 2, 3, 4} and sample == [r.pmid for r in retrieve.random_subset(pool, 10, 5, include).collect()]
    assert retrieve.negatives(pool, include, ids).count() == 1 and retrieve.negatives(pool, include, 500).count() == 96


def test_query_end_to_end(toy, tmp_path, spark):
    docs, vocab, positives = toy
    results, inputs, m = retrieve.query(docs, vocab, positives)
    assert {r.pmid for r in results.collect()} == {4, 5, 6} and [r.pmid for r in retrieve.ranked(inputs).orderBy("rank").collect()] == [3, 1, 2]
    path = str(tmp_path / retrieve.query_key(Params()))
    first = retrieve.remembered(lambda: results, path, spark)
    again = retrieve.remembered(lambda: 1 / 0, path, spark)
    assert first.count() == again.count() == 3
    assert retrieve.query_key(Params()) != retrieve.query_key(Params(limit=3))
    assert retrieve.ids_key(positives) == retrieve.ids_key(positives.repartition(3).union(positives)) != retrieve.ids_key(positives.where("pmid > 1"))
    ranks = retrieve.truepos_vs_rank(retrieve.ranked(retrieve.score(docs, m)), positives).orderBy("rank").collect()
    assert ranks[0].precision == 1 and ranks[-1].tp == 3 and ranks[-1].recall == 1


def test_sweep_is_one_model_each(toy):
    docs, vocab, positives = toy
    counts, totals = model.counts_by_subtraction(docs, vocab, positives)
    grid = sweep.smoothing_grid() | sweep.cutoff_grid() | sweep.mask_grid(Params(), ("w", "mesh"))
    got = {(r.config, r.pmid): r.score for r in sweep.score_all(docs, sweep.train_all(counts, totals, grid)).collect()}
    for name, params in list(grid.items())[::4]:
        for r in retrieve.score(docs, model.train(counts, totals, params)).collect():
            assert got[name, r.pmid] == pytest.approx(r.score)


def test_tasks():
    assert Task("a b", ids=tuple(range(40)), operation="validation").problems() == []
    bad = Task("", operation="x", limit=5, minscore=2000, numnegs=1, delcode="é")
    assert len(bad.problems()) == 6 and Task("a", operation="validation").problems()
    assert Task("a").params().method == "bgfreq" and Task("a", allfeatures=True).params().method == "laplace_split"
    with pytest.raises(ValueError):
        Params(method="none")


def test_numbers_and_sums_by_range(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 11).alias("v"))
    got = {r.k: (r.n, r.total, r.after) for r in order.with_next(order.running(order.numbered(rows, [F.desc("k")], "n"), [F.desc("k")], {"total": "v"}), [F.desc("k")], {"after": "v"}).collect()}
    plain, total = sorted(((r.k, r.v) for r in rows.collect()), reverse=True), 0
    for i, (k, v) in enumerate(plain):
        total += v
        assert got[k] == (i + 1, total, plain[i + 1][1] if i < 499 else None)
    assert order.numbered(rows.limit(0), ["k"], "n").count() == 0 and order.running(rows.limit(0), ["k"], {"t": "v"}).count() == 0


def test_threshold_query_has_no_limit(spark, sf_dir):
    plan = QUERIES["retrieve_threshold"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Window" not in plan
