"""Whole results of queries that have a limit of their own, and plans that keep tasks small."""

import re

from gleaner.config import SPACES, Params
from gleaner.operators import blocks, dense, features, index, model, retrieve, sweep
from gleaner.plans import catalog, files
from gleaner.session import Cuts
from gleaner.sources import corpora


def test_report_has_all_results(spark, sf_dir):
    """The pages of a report hold every result of its retrieval, not the first 150."""
    docs, vocab = catalog.text_corpus(spark, sf_dir)
    positives = corpora.toxic_labels(spark, sf_dir).where("label = 1").select("pmid")
    found = retrieve.query(docs, vocab, positives, Params(limit=200))[0]
    want = {(r.pmid, r["rank"]) for r in found.collect()}
    got = files.QUERIES["query_report"](spark, sf_dir).collect()
    assert len(want) > 150 and {(r.pmid, r["rank"]) for r in got} == want


def test_scores_are_summed_where_documents_are(spark, monkeypatch):
    """Few weights: no shuffle of documents; many: a join, with the same scores, repeated and unknown features included."""
    docs = spark.createDataFrame([(1, 19990101, [1, 2, 2]), (2, 19990101, []), (3, 19990101, [3, 9]), (4, 19990101, None), (5, 19990101, [2, 1])], "pmid long, date_key int, features array<int>")
    weights = spark.createDataFrame([(1, 0.5), (2, -1.25), (3, 2.0), (4, 0.0)], "fid int, score double")
    m = model.Model(weights, spark.createDataFrame([(0.25, -1.0)], "base double, prior double"))
    near = retrieve.score(docs, m)
    assert "Exchange hashpartitioning" not in near._jdf.queryExecution().executedPlan().toString()
    want = {1: -1.5, 2: -0.75, 3: 1.25, 4: -0.75, 5: -1.5}
    assert {r.pmid: r.score for r in near.collect()} == want
    monkeypatch.setattr(dense, "MOST", 0)
    assert {r.pmid: r.score for r in retrieve.score(docs, m).collect()} == want


def test_sweeps_sort_no_configuration_whole(spark, sf_dir, monkeypatch):
    """The best of each configuration are taken task by task; joined weights give the same."""
    docs, vocab, positives = catalog.basket(spark, sf_dir)
    counts, totals = model.counts_by_subtraction(docs, vocab, positives)
    m = sweep.train_all(counts, totals, sweep.smoothing_grid())
    got = sweep.ranked_all(sweep.score_all(docs, m), 7)
    assert got._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject") == 4
    rows = sorted(got.collect())
    assert len(rows) == 28
    monkeypatch.setattr(dense, "MOST", 0)
    assert sorted(sweep.ranked_all(sweep.score_all(docs, m), 7).collect()) == rows


def test_vectors_of_sets_are_those_of_rows(spark, monkeypatch):
    """A type and a name that run into each other, repeated, unknown and no names."""
    shape = "pmid long, date_key int, names array<struct<ftype string, fname string>>"
    sets = spark.createDataFrame([(1, 1, [("a", "bc"), ("ab", "c"), ("a", "bc")]), (2, 1, None), (3, 2, [("x", "y")]), (4, 2, [("ab", "c")])], shape)
    vocab = spark.createDataFrame([(7, "a", "bc", 1), (2, "ab", "c", 2)], "fid int, ftype string, fname string, df long")
    want = [(1, 1, [2, 7]), (2, 1, []), (3, 2, []), (4, 2, [2])]
    near = index.vectors_of_sets(sets, vocab)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, near.collect())) == want
    monkeypatch.setattr(dense, "MOST_NAMES", 0)
    assert sorted(map(tuple, index.vectors_of_sets(sets, vocab).collect())) == want


def test_a_space_is_extracted_once(spark, sf_dir, monkeypatch):
    """Fourteen codes, eight spaces: eight passes over the texts."""
    made = []
    real = features.extract
    monkeypatch.setattr(features, "extract", lambda articles, space: made.append(space) or real(articles, space))
    files.QUERIES["space_codes"](spark, sf_dir)
    assert sorted(made) == sorted({space for space, _ in SPACES.values()})


def test_word_indexes_shuffle_a_row_per_block_and_name(spark, tmp_path, monkeypatch):
    """Null, empty and repeated texts; names of blocks, not of documents, meet the vocabulary; the index is that of a join."""
    shape = "pmid long, date_key int, names array<struct<ftype string, fname string>>"
    rows = [(k, 1, [("w", f"{x}:é{x % 7}") for x in sorted({k % 5, k % 3 + 10, k % 2 + 20})]) for k in range(300)]
    sets = spark.createDataFrame([*rows, (300, 2, None), (301, 2, []), (302, 2, [("w", "once")]), (7, 3, [("w", "0:é0"), ("a", "b:c")])], shape)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    docs, terms = blocks.coded_names(sets.coalesce(2), Cuts(spark, "blocks"))
    want = index.document_frequency(index.long_of(sets))
    assert sorted(map(tuple, blocks.document_frequency(terms).collect())) == sorted(map(tuple, want.collect()))
    # a batch is never cut, so two tasks of one batch are two blocks
    assert terms.count() <= 2 * want.count() < index.long_of(sets).count() and docs.count() == sets.count()
    tables = catalog.word_index_tables(spark, sets, 2)
    vocab = tables["vocabulary"]
    assert {r.fname for r in vocab.collect()} == {r.fname for r in want.where("df > 1").collect()}
    ids = {(r.ftype, r.fname): r.fid for r in vocab.collect()}
    made = sorted((r.pmid, r.date_key, sorted({ids[tuple(x)] for x in r.names or [] if tuple(x) in ids})) for r in sets.collect())
    assert sorted(map(tuple, tables["vectors"].collect())) == made


def test_weights_are_sent_in_slices(spark, monkeypatch):
    """A model over several slices gives the scores of one; a join by blocks too."""
    docs = spark.createDataFrame([(k, 19990101, [k % 7, k % 11, 30, 99]) for k in range(50)] + [(50, 19990101, None)], "pmid long, date_key int, features array<int>")
    m = model.Model(spark.createDataFrame([(k, k / 8 - 1) for k in range(31)], "fid int, score double"), spark.createDataFrame([(0.25, -1.0)], "base double, prior double"))
    want = sorted(retrieve.score(docs, m).collect())
    monkeypatch.setattr(dense, "SLICE", 4)
    assert len(dense.table(m.weights, ["score"])) == 8
    assert sorted(retrieve.score(docs, m).collect()) == want
    monkeypatch.setattr(dense, "MOST", 0)
    assert sorted(retrieve.score(docs, m).collect()) == want


def test_positives_are_met_without_a_shuffle_of_documents(spark, sf_dir, monkeypatch):
    """Ids are joined by their own size: a table too large to be broadcast whole has few positives, which are."""
    docs, vocab, positives = catalog.basket(spark, sf_dir)
    plans = []
    real = Cuts.write
    monkeypatch.setattr(Cuts, "write", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(self, df))
    want = sorted(retrieve.query(docs, vocab, positives, Params(limit=50))[0].collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
        plans.clear()
        got = retrieve.query(docs, vocab, positives, Params(limit=50))[0]
        assert sorted(got.collect()) == want
        joins = re.findall("(BroadcastHash|SortMerge)Join .*Left(?:Semi|Anti)", "\n".join([*plans, got._jdf.queryExecution().executedPlan().toString()]))
        assert set(joins) == {"BroadcastHash"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sets_of_orders_come_from_plain_rows(spark, sf_dir):
    """Line items are shuffled before sets are made of them, not as sets of one or two."""
    plan = corpora.basket_sets(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("collect_set") < plan.index("REPARTITION_BY_COL") and "collect_set" not in plan[plan.index("REPARTITION_BY_COL"):]


def test_line_items_are_shuffled_as_codes(spark, sf_dir, tmp_path, monkeypatch):
    """Names that are null, empty or long, repeated lines and lines without a part: the sets of strings, from one long a line item."""
    names = [None, "", "a", "é" * 40, "b", "a b"]
    parts = [(k, names[k % 6], names[k % 5], None if k % 7 == 0 else k % 4) for k in range(60)]
    lines = [(k % 40, (k * 17) % 70, names[k % 3]) for k in range(400)] + [(99, None, "x"), (None, 3, "x"), (98, 0, None)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")

    def made():
        got = [(r.pmid, [tuple(x) for x in r.names]) for r in corpora.basket_sets(spark, str(tmp_path)).collect()]
        assert all(len(set(n)) == len(n) for _, n in got)
        return sorted(((p, sorted(n)) for p, n in got), key=str)

    by_part = {p[0]: p[1:] for p in parts}
    want = {}
    for order, part, flag in lines:
        if part in by_part:
            brand, kind, size = by_part[part]
            said = {"brand": brand, "type": kind, "size": None if size is None else str(size), "flag": flag}
            want.setdefault(order, set()).update((k, v) for k, v in said.items() if v is not None)
    want = sorted(((p, sorted(n)) for p, n in want.items()), key=str)
    assert made() == want
    plan = corpora.basket_sets(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "collect_set(code" in plan and "collect_set(p_" not in plan and "ObjectHashAggregate" not in plan
    # more names than codes
    monkeypatch.setattr(corpora, "MOST_CODES", 3)
    assert made() == want
