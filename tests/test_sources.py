"""Readers, writers, result tables, co-occurrence, ingestion and the task queue."""

import datetime
import gzip
import random
import re
import shutil
import sqlite3
import struct
import time

import pytest
from pyspark.sql import functions as F

from gleaner.config import Params
from gleaner.operators import browse, cooccur, model, retrieve
from gleaner.sources import files, readers, writers
from gleaner.streaming import growing, ingest, tasks


def record(pmid, status="MEDLINE", full=True):
    rest = (
        "<Journal><ISSN IssnType='Print'>1-2</ISSN><JournalIssue><PubDate><Year>1999</Year></PubDate></JournalIssue></Journal><ArticleTitle>T&amp;1 é</ArticleTitle>"
        "<Abstract><AbstractText>first</AbstractText><AbstractText>second</AbstractText></Abstract><AuthorList><Author><LastName>L1</LastName><Initials>F1</Initials></Author><Author><LastName>L2</LastName></Author></AuthorList>"
        if full
        else "<ArticleTitle>Only</ArticleTitle>"
    )
    more = "<MedlineJournalInfo><MedlineTA>JJ</MedlineTA></MedlineJournalInfo><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN='N'>D1</DescriptorName></MeshHeading><MeshHeading><DescriptorName>D3</DescriptorName><QualifierName>Q1</QualifierName><QualifierName>Q2</QualifierName></MeshHeading></MeshHeadingList>" if full else ""
    return f"<MedlineCitation Status='{status}'><PMID Version='1'>{pmid}</PMID><DateCompleted><Year>2000</Year><Month>06</Month><Day>29</Day></DateCompleted><Article>{rest}</Article>{more}</MedlineCitation>"


def write_xml(path, *records):
    body = "<?xml version='1.0' encoding='utf-8'?><MedlineCitationSet>" + "".join(records) + "</MedlineCitationSet>"
    (gzip.open if path.suffix == ".gz" else open)(path, "wt", encoding="utf-8").write(body)


def test_citations(spark, tmp_path):
    write_xml(tmp_path / "a.xml", record(1), record(2, full=False), record(3, "In-Process"))
    write_xml(tmp_path / "b.xml.gz", record(4))
    rows = {r.pmid: r for r in readers.read_citation_directory(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 2, 4]
    a = rows[1]
    assert (a.title, a.abstract, a.journal, a.issn, a.pubyear, a.date_completed) == ("T&1 é", "first", "JJ", "1-2", 1999, datetime.date(2000, 6, 29))
    assert [tuple(x) for x in a.authors] == [("F1", "L1"), (None, "L2")]
    assert [(m.descriptor, m.qualifiers) for m in a.meshterms] == [("D1", []), ("D3", ["Q1", "Q2"])]
    b = rows[2]
    assert (b.title, b.abstract, b.journal, b.pubyear, b.authors, b.meshterms) == ("Only", None, None, None, [], [])
    seen = spark.createDataFrame([("a.xml",)], "name string")
    assert [r.pmid for r in readers.read_citation_directory(spark, str(tmp_path), seen).collect()] == [4]


def test_id_files(spark, tmp_path):
    (tmp_path / "ids").write_text("# head\n\n1 10\n2 20 blah\n 3 30\n4 40\n5 50\n5 50\n")
    assert [r.pmid for r in readers.read_ids(spark, str(tmp_path / "ids")).collect()] == [1, 2, 3, 4, 5, 5]
    assert [tuple(r) for r in readers.read_scores(spark, str(tmp_path / "ids")).collect()][:2] == [(10, 1), (20, 2)]
    (tmp_path / "dates").write_text("1 20010101\n2 20020101\n3 20030101\n")
    dated = readers.read_dated_ids(spark, str(tmp_path / "dates"))
    assert [r.pmid for r in readers.dated_subset(dated, 20010202).collect()] == [2, 3] and readers.dated_subset(dated, count=2).count() == 2
    assert [r.value for r in writers.dated_lines(dated).collect()][0] == "1 20010101"
    (tmp_path / "stop").write_text("The\n\nof\n")
    assert readers.read_stopwords(spark, str(tmp_path / "stop")) == ("of", "the")
    table = spark.createDataFrame([(i,) for i in (3, 2, 1)], "pmid long")
    wanted = spark.createDataFrame([(3,), (2,), (3,), (9,)], "pmid long")
    assert [r.pmid for r in readers.lookup(table, wanted).collect()] == [2, 3] and [r.pmid for r in readers.missing(table, wanted).collect()] == [9]
    assert readers.point(table, 9).isEmpty()


def test_descriptors(spark, tmp_path):
    lines = writers.descriptor_lines({"dataset": "x", "limit": 500, "hidden": True, "mindate": None, "other": 1}, [7, 8])
    assert lines == ["#dataset = x", "#limit = 500", "#hidden = True", "#mindate = None", "7", "8"]
    assert readers.parse_descriptor(lines) == {"dataset": "x", "limit": 500, "hidden": True, "mindate": None}
    with pytest.raises(KeyError):
        readers.parse_descriptor(["#what = 1"])
    with pytest.raises(ValueError):
        readers.parse_descriptor(["#hidden = maybe"])
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n")
    row = readers.read_descriptors(spark, str(tmp_path)).first()
    assert row.ids == [7, 8] and row.header["limit"] == "500"


def test_drugs(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    got = readers.drugs_from_lines(lines("P1\tMain\ta|b|\tc|", "", "P2\tOnly\t\t\r")).collect()
    assert [(r.drug_id, r.aliases) for r in got] == [("P1", ["Main", "a", "b", "c"]), ("P2", ["Only"])]
    for bad in ("P1\tMain\ta|", "P1\tMain\ta\t"):
        with pytest.raises(Exception, match="fields|pipe"):
            readers.drugs_from_lines(lines(bad)).collect()


def test_cooccurrence(spark):
    drugs = spark.createDataFrame([("K1", "Abc def", ["Abc def", "xy"]), ("K2", "def", ["defen", "abc"]), ("K3", "no", ["no"])], "drug_id string, name string, aliases array<string>")
    patterns = {r.drug_id: r.pattern for r in cooccur.drug_patterns(drugs).collect()}
    assert patterns == {"K1": r"\b(abc\s+def)\b", "K2": r"\b(defen)\b"}
    text = "One ABC-def geneA here. Then geneB alone. Defen and geneC? Defen geneC, abc  def geneD."
    texts = spark.createDataFrame([(1, text), (2, None), (3, "")], "text_id long, text string")
    found = cooccur.find_drugs(texts, drugs)
    assert sorted((r.drug_id, r.surface, r.start) for r in found.collect()) == [("K1", "ABC-def", 4), ("K1", "abc  def", text.index("abc  def")), ("K2", "Defen", 42), ("K2", "Defen", 59)]
    spans = [(1, g, text.index(g), text.index(g) + 5, 0.9) for g in ("geneA", "geneB", "geneC", "geneD")] + [(1, "weak", 0, 3, 0.5), (1, "overlap", 4, 9, 0.95), (1, "touch", 0, 4, 0.95)]
    genes = spark.createDataFrame(spans, "text_id long, name string, start int, end int, score double")
    pairs = cooccur.cooccurrences(texts, found, cooccur.gene_spans(genes))
    assert {r.drug: r.genes for r in pairs.collect()} == {"Abc def": ["geneA", "geneD"], "def": ["geneC", "geneD"]}
    assert {(r.gene, r.drug): r.n for r in cooccur.global_pairs(pairs).collect()}[("geneD", "def")] == 1
    assert {r.number for r in cooccur.in_sentences(texts, found).collect()} == {0, 2, 3}
    assert cooccur.stored_spans(genes).count() == 7 and cooccur.new_texts(texts, pairs).count() == 2
    ids = spark.createDataFrame([(1,), (2,)], "pmid long")
    assert [r.pmid for r in cooccur.with_association(ids, pairs).collect()] == [1]


def by_patterns(said, drugs):
    """Each drug's pattern run over each text."""
    out = []
    for i, t in said:
        low = re.sub("[^a-z0-9]", " ", t.lower())
        for drug, _, aliases in drugs:
            kept = dict.fromkeys(re.sub("[^a-z]+", " ", a.lower()).strip().replace(" ", r"\s+") for a in aliases)
            if any(len(a) > 3 for a in kept):
                out += [(i, drug, *m.span(), t[slice(*m.span())]) for m in re.finditer(r"\b(?:" + "|".join(a for a in kept if len(a) > 3) + r")\b", low)]
    return sorted(out)


def test_all_aliases_in_one_pass(spark, monkeypatch):
    """Overlaps, aliases that begin others, their order, repeated drugs, signs and digits between words, several passes."""
    rng = random.Random(2)
    words = ["aa", "aab", "ab", "abcd", "b", "ABCD", "é", "a1", "x-y"]
    said = [(i, "".join(rng.choice([*words, " ", "  ", "-", ". ", " 7 "]) + rng.choice([" ", ""]) for _ in range(rng.randrange(40)))) for i in range(120)]
    drugs = [(f"D{k}", f"n{k % 7}", [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(rng.randrange(4))]) for k in range(60)] + [("D1", "again", ["abcd", "aa ab"])]
    texts = spark.createDataFrame([*said, (500, None)], "text_id long, text string")
    table = spark.createDataFrame(drugs, "drug_id string, name string, aliases array<string>")
    want = by_patterns(said, drugs)
    for chars in (cooccur.PASS_CHARS, 100):
        monkeypatch.setattr(cooccur, "PASS_CHARS", chars)
        got = cooccur.find_drugs(texts, table).collect()
        assert sorted((r.text_id, r.drug_id, r.start, r.end, r.surface) for r in got) == want and len(want) > 500
    assert cooccur.find_drugs(texts, table.limit(0)).count() == 0 and cooccur.find_drugs(texts.limit(0), table).count() == 0


def test_many_aliases_cost_little(spark):
    """A hundred thousand aliases take about the time of three."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = spark.createDataFrame([(i, " ".join(word() for _ in range(300))) for i in range(2000)], "text_id long, text string").repartition(4).persist()
    many = spark.createDataFrame([(str(k), "n", [f"{word()} {word()}", word()]) for k in range(50_000)], "drug_id string, name string, aliases array<string>").persist()
    seconds = []
    assert texts.count() + many.count() == 52_000
    for drugs in (many.limit(3), many.limit(3), many):
        began = time.perf_counter()
        cooccur.find_drugs(texts, drugs).write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    assert seconds[2] < 4 * seconds[1] + 10, seconds


def test_export(spark, tmp_path):
    found = spark.createDataFrame([(1, "d1", ["g1", "g2"]), (2, "d1", ["g1"]), (1, "d2", ["g'3"])], "text_id long, drug string, genes array<string>")
    articles = spark.createDataFrame([(1, "It's", "x" * 3000), (2, None, "")], "pmid long, title string, abstract string")
    tables = cooccur.star_schema(found, articles)
    assert {k: t.count() for k, t in tables.items()} == {"genedrug": 3, "dg_pmids": 4, "cbs": 2}
    cbs = {r.pmid: r for r in tables["cbs"].collect()}
    assert len(cbs["1"].abs) == 2450 and cbs["2"].abs is None and cbs["1"].genes == "g'3 g1 g2" and cbs["1"].drugs == "d1 d2"
    said = [r.value for r in cooccur.insert_statements(tables["cbs"].drop("abs"), "cbs").collect()]
    assert any("'It''s'" in s and "'g''3 g1 g2'" in s for s in said) and any("('2', NULL," in s for s in said)
    writers.export_sqlite(tables, str(tmp_path / "x.db"))
    assert sqlite3.connect(tmp_path / "x.db").execute("select numarticles from genedrug where gene = 'g1'").fetchall() == [(2,)]
    writers.export_sql(tables, str(tmp_path / "sql"))
    assert spark.read.text(str(tmp_path / "sql/1_genedrug")).count() == 3
    assert cooccur.pair_rows(found).count() == 4


def results(spark, n=10):
    rows = [(i, i, 100.0 - i, datetime.date(2000, 1, i % 28 + 1), [("F", f"N{i % 3}")] if i % 4 else [], f"Title {i}", "About" if i % 2 else None, None if i % 5 else "Jo", "1-1") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "rank int, pmid long, score double, date_completed date, authors array<struct<initials:string,lastname:string>>, title string, abstract string, journal string, issn string")


def test_browse(spark):
    rows = browse.rendered(results(spark))
    first = rows.where("rank = 1").first()
    assert (first.shown_score, first.date, first.authors, first.journal) == ("99.00", "2000.01.02", "F N1", "1-1")
    seen = browse.visible(rows, browse.Filter(minscore=92, title_or_abstract="ABOUT", exclude="title 3"))
    assert [r.pmid for r in seen.where("visible").orderBy("rank").collect()] == [1, 5, 7]
    assert [r.pmid for r in browse.inverted(browse.visible(seen, browse.Filter(journal="jo"))).where("not visible").collect()] == [5]
    assert [r.pmid for r in browse.sorted_by(rows, "author").collect()][-2:] == [4, 8]
    assert [r.pmid for r in browse.sorted_by(rows, "date").collect()][0] == 10
    assert browse.joined_ids(seen).first().ids == "1,5,7"
    tags = spark.createDataFrame([(1, 1), (2, 0)], "pmid long, tag int")
    back = browse.read_tags(browse.tag_lines(browse.tagged(rows, tags)))
    assert {r.pmid: r.tag for r in back.collect() if r.pmid < 4} == {1: 1, 2: 0, 3: None}


@pytest.mark.parametrize(("n", "per", "sizes"), [(10, 4, [4, 4, 2]), (9, 4, [4, 5]), (3, 4, [3]), (8, 4, [4, 4]), (1, 4, [1]), (0, 4, [])])
def test_pages(spark, n, per, sizes):
    got = browse.paged(results(spark, n), per).groupBy("page").count().orderBy("page").collect()
    assert [r["count"] for r in got] == sizes


def test_writers_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([(i, 20000101, [1 + i % 2, 3]) for i in range(20)], "pmid long, date_key int, features array<int>")
    vocab = spark.createDataFrame([(1, "w", "a", 10), (2, "w", "b", 10), (3, "w", "c", 20)], "fid int, ftype string, fname string, df long")
    positives = docs.where("pmid in (1, 3, 5, 7)").select("pmid")
    found, inputs, m = retrieve.query(docs, vocab, positives)
    articles = results(spark, 19).drop("rank", "score")
    tables = writers.query_report(found, inputs, m, articles, Params())
    writers.write_report(tables, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/results")).count() == 15
    writers.write_feature_csv(m, str(tmp_path / "f.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f.csv")).count() == 3
    scores = found.select("pmid", "score")
    writers.write_text(writers.score_lines(scores), str(tmp_path / "scores"))
    assert readers.read_scores(spark, str(tmp_path / "scores")).count() == 16
    assert writers.lines(scores.limit(1)).first().value.count("\t") == 1 and writers.id_lines(positives).count() == 4
    labelled = retrieve.score(docs, m).withColumn("label", (F.col("pmid") % 2).cast("int")).withColumn("fold", (F.col("pmid") % 3).cast("int"))
    report = writers.validation_report(labelled, m)
    assert all(t.count() for t in report.values())
    assert len(writers.experiment_row("x", labelled, m).first()) == 16
    assert writers.rank_lines(retrieve.truepos_vs_rank(found, positives)).first().value.startswith("1, 0")
    (tmp_path / "z").mkdir()
    (tmp_path / "z/a.txt").write_text("x")
    writers.zip_directory(str(tmp_path / "z"), str(tmp_path / "z.zip"))
    assert (tmp_path / "z.zip").stat().st_size > 0
    assert model.best_features(m.weights).count() == 3


#: Records of a feature stream. (Fixed values.)
VECTORS = [(12, 20070101, [1, 2, 6, 5484]), (34, 19980308, [5, 6, 8342, 9000, 9001]), (56, 20001207, [])]


def test_feature_stream(spark, tmp_path, monkeypatch):
    """Round trip in any number of parts; the file as other programs have it; bad lengths and cut records are errors."""
    kind = "pmid long, date_key int, features array<int>"
    files.write_feature_stream(spark.createDataFrame(VECTORS, kind).coalesce(1), str(tmp_path / "a"))
    (path,) = (tmp_path / "a").glob("*.stream")
    said = bytes.fromhex("0c000000d53e32010500" + "8181842ae6" + "2200000014e030010700" + "85814190059281" + "38000000b73131010000")
    assert path.read_bytes() == said
    for part, n in ((1, 3), (20, 2), (1 << 20, 1)):
        got = files.read_feature_stream(spark, str(path), part=part)
        assert sorted(map(tuple, got.collect())) == VECTORS and got.rdd.getNumPartitions() == n
    many = spark.range(20_000).selectExpr("id AS pmid", "CAST(20000101 + id % 28 AS INT) AS date_key", "transform(sequence(1, CAST(1 + id % 40 AS INT)), x -> CAST(x * x * 7 AS INT)) AS features")
    files.write_feature_stream(many.repartition(5), f"file://{tmp_path}/b")
    back = files.read_feature_stream(spark, f"file://{tmp_path}/b", part=50_000)
    assert back.rdd.getNumPartitions() > 10 and back.exceptAll(many).count() == 0 and back.count() == 20_000
    for bad, message in ((said[:-1], "cut off"), (said[:-11], "cut off"), (said + bytes(4), "cut off"), (said[:8] + b"\xff\x7f" + said[10:], "a record of 32767 bytes")):
        (tmp_path / "bad.stream").write_bytes(bad)
        with pytest.raises(Exception, match=message):
            files.read_feature_stream(spark, str(tmp_path / "bad.stream"), longest=1000).collect()
    (tmp_path / "none.stream").write_bytes(b"")
    assert files.read_feature_stream(spark, str(tmp_path / "none.stream")).count() == 0
    with pytest.raises(Exception, match="too long"):
        files.write_feature_stream(spark.createDataFrame([(1, 1, list(range(0, 70_000)))], kind), str(tmp_path / "long"))
    assert not list((tmp_path / "long").glob("part-*"))


def test_records_in_small_chunks(tmp_path, monkeypatch):
    """Heads and features that reach over the ends of chunks."""
    monkeypatch.setattr(files, "CHUNK", 37)
    rng = random.Random(1)
    rows = [(i, 20000101 + i, rng.randbytes(rng.randrange(60))) for i in range(300)]
    path = tmp_path / "r.stream"
    path.write_bytes(b"".join(struct.pack("<IIH", i, d, len(c)) + c for i, d, c in rows))
    records = files.Records(str(path), 100)
    assert [(i, d, bytes(c)) for _, i, d, c in records.heads(0, None)] == rows
    borders = records.borders(500)
    assert [(i, d, bytes(c)) for a, b in zip(borders, borders[1:], strict=False) for _, i, d, c in records.heads(a, b)] == rows and len(borders) > 10


def test_statements_are_written_whole_or_not(spark, tmp_path):
    """Order over parts, strings with semicolons, quotes and line ends; what was there stays if a write fails."""
    said = [f"INSERT INTO t VALUES ({i}, 'it''s; {i};\n'';\n é');" for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, statement string").repartitionByRange(7, "k").sortWithinPartitions("k")
    path = str(tmp_path / "s")
    files.write_statements(rows, path)
    assert [r.statement for r in files.read_statements(spark, path).orderBy("part", "number").collect()] == said
    seen = lambda: (sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith("_staging")), (tmp_path / "s/_manifest.json").read_text())
    old = seen()
    fails = rows.withColumn("statement", F.when(F.col("k") == 299, F.raise_error(F.lit("lost"))).otherwise(F.col("statement")))
    with pytest.raises(Exception, match="lost"):
        files.write_statements(fails, path)
    # a task that outlives the failure may leave a hidden folder; what is read stays
    assert seen() == old and [r.statement for r in files.read_statements(spark, path).orderBy("part", "number").collect()] == said
    with pytest.raises(Exception, match="FileExists"):
        files.write_statements(rows, path, "append")
    files.write_statements(rows.where("k < 2"), path)
    assert [r.statement for r in files.read_statements(spark, path).orderBy("part", "number").collect()] == said[:2] and len(list((tmp_path / "s").glob("part-*"))) <= 2


def named(rows):
    return {(r.ftype, r.fname): (r.fid, r.df) for r in rows.collect()}


def test_growing_index(spark, tmp_path):
    """Ids stay whatever comes later; what is not committed is not seen; a batch again and articles again change nothing."""
    batches = growing.Batches(spark, str(tmp_path / "grown"))
    own = growing.GrowingIndex(batches)
    articles = lambda *ids: spark.createDataFrame([(i, 20000100 + i) for i in ids], "pmid long, date_key int")
    long = lambda *rows: spark.createDataFrame(list(rows), "pmid long, ftype string, fname string")
    assert own.vocabulary().count() == 0 and own.vectors().count() == 0
    own.add(articles(1, 9), long((1, "Q", "A"), (1, "Q", "B"), (1, "T", "A"), (1, "T", "C")), 0)
    assert own.vocabulary().count() == 0  # not committed
    batches.commit(0)
    assert named(own.vocabulary()) == {("Q", "A"): (1, 1), ("Q", "B"): (2, 1), ("T", "A"): (3, 1), ("T", "C"): (4, 1)}
    own.add(articles(2), long((2, "A", "first"), (2, "Z", "z")), 1)  # fails before its commit, and runs again with other rows
    own.add(articles(2, 1), long((2, "Q", "B"), (2, "Q", "D\u00d8"), (1, "T", "new")), 1)
    batches.commit(1)
    known = {("Q", "A"): (1, 1), ("Q", "B"): (2, 2), ("T", "A"): (3, 1), ("T", "C"): (4, 1), ("Q", "D\u00d8"): (5, 1)}
    assert named(own.vocabulary()) == known
    vectors = {1: [1, 2, 3, 4], 9: [], 2: [2, 5]}
    assert {r.pmid: r.features for r in own.vectors().collect()} == vectors
    for _ in range(2):
        batches.merge(own.tables())
        assert named(own.vocabulary()) == known and batches.folders() == [-2] and batches.last() == 1 and batches.committed(0)
    own.add(articles(3), long((3, "A", "x"), (3, "T", "C")), 2)
    batches.commit(2)
    assert named(own.vocabulary()) == known | {("A", "x"): (6, 1), ("T", "C"): (4, 2)} and batches.folders() == [-2, 2]
    batches.merge(own.tables())
    assert {r.pmid: r.features for r in own.vectors().collect()} == vectors | {3: [4, 6]}
    everything = long((1, "Q", "A"), (1, "Q", "B"), (1, "T", "A"), (1, "T", "C"), (2, "Q", "B"), (2, "Q", "D\u00d8"), (3, "A", "x"), (3, "T", "C"))
    shutil.rmtree(tmp_path / "grown/index/vectors")
    assert own.regenerate(articles(1, 2, 3, 9), everything) == ["vectors"] and own.regenerate(articles(1), everything) == []
    assert {r.pmid: r.features for r in own.vectors().collect()} == vectors | {3: [4, 6]}
    shutil.rmtree(tmp_path / "grown/index/names")
    with pytest.raises(ValueError, match="names are gone"):
        own.regenerate(articles(1), everything)
    for name in ("counts", "vectors"):
        shutil.rmtree(tmp_path / "grown/index" / name)
    assert own.regenerate(articles(1, 2, 3, 9), everything) == ["names", "counts", "vectors"]
    assert {k: df for k, (_, df) in named(own.vocabulary()).items()} == {("Q", "A"): 1, ("Q", "B"): 2, ("T", "A"): 1, ("T", "C"): 2, ("Q", "D\u00d8"): 1, ("A", "x"): 1}


def test_a_batch_touches_its_own_rows(spark, tmp_path):
    """Adding scans names and document ids of what is there, not its vectors' features nor counts."""
    batches = growing.Batches(spark, str(tmp_path / "grown"))
    own = growing.GrowingIndex(batches)
    for k in range(2):
        own.add(spark.range(10 * k, 10 * k + 10).selectExpr("id AS pmid", "20000101 AS date_key"), spark.range(20).selectExpr("id AS pmid", "'t' AS ftype", "string(id % 7) AS fname"), k)
        batches.commit(k)
    plan = own.vectors().select("pmid")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<pmid:bigint>" in plan
    assert sorted(p.name for p in (tmp_path / "grown/index").iterdir()) == ["counts", "names", "vectors"]
    assert sum(1 for _ in (tmp_path / "grown/index/vectors/batch=1").glob("*.parquet")) > 0
    assert spark.read.parquet(str(tmp_path / "grown/index/vectors/batch=1")).count() == 10


def test_ledger_of_base_names(spark, tmp_path):
    """A name that is in brings nothing from any directory; names are taken in order; a failed batch runs again."""
    store = ingest.Store(spark, str(tmp_path / "store"), ("mqi",))
    for d in "abc":
        (tmp_path / "in" / d).mkdir(parents=True)
    write_xml(tmp_path / "in/b/2.xml", record(2), record(3, full=False))
    write_xml(tmp_path / "in/a/3.xml", record(3))
    run = lambda: ingest.ingest(store, str(tmp_path / "in/*"), str(tmp_path / "cp"))
    run()
    titles = lambda: {r.pmid: r.title for r in store.articles().collect()}
    assert titles() == {2: "T&1 é", 3: "Only"}  # of 3 the file that is first by name
    write_xml(tmp_path / "in/c/2.xml", record(7))  # a name that is in
    write_xml(tmp_path / "in/b/4.xml", record(8))
    write_xml(tmp_path / "in/a/4.xml", record(9))  # twice in one batch: the first path counts
    extract, left = ingest.extract, [1]

    def failing(*x):
        if left:
            left.pop()
            raise OSError("lost")
        return extract(*x)

    ingest.extract = failing
    try:
        with pytest.raises(Exception, match="lost"):
            run()
        assert set(titles()) == {2, 3} and store.files().count() == 2
        run()
    finally:
        ingest.extract = extract
    assert set(titles()) == {2, 3, 9} and sorted(r.name for r in store.files().collect()) == ["2.xml", "3.xml", "4.xml"]
    before = store.frequencies("mqi").collect()
    store.compact()
    assert sorted(before) == sorted(store.frequencies("mqi").collect()) and store.regenerate("mqi") == []
    run()
    assert set(titles()) == {2, 3, 9}


def test_ingest(spark, tmp_path):
    source, store = tmp_path / "in", ingest.Store(spark, str(tmp_path / "store"), ("mqi",))
    source.mkdir()
    write_xml(source / "a.xml", record(1), record(2, full=False))
    ingest.ingest(store, str(source), str(tmp_path / "cp"))
    write_xml(source / "b.xml", record(1), record(5))
    ingest.ingest(store, str(source), str(tmp_path / "cp"))
    ingest.ingest(store, str(source), str(tmp_path / "cp"))
    assert sorted(r.pmid for r in store.articles().collect()) == [1, 2, 5]
    assert {(r.ftype, r.fname): r.df for r in store.frequencies("mqi").collect()} == {("mesh", "D1"): 2, ("mesh", "D3"): 2, ("qual", "Q1"): 2, ("qual", "Q2"): 2, ("issn", "1-2"): 2}
    store.add(readers.read_citations(spark, str(source / "b.xml")), 1)  # the batch again
    assert store.frequencies("mqi").where("fname = 'D1'").first().df == 2
    docs, vocab = store.index("mqi")
    assert vocab.count() == 5 and {r.pmid: len(r.features) for r in docs.collect()} == {1: 5, 2: 0, 5: 5}


def test_queue(spark):
    rows = [("b", 2.0, None, 5.0), ("a", 1.0, None, 5.0), ("new", 0.5, None, 9.95), ("old", 0.1, 3.0, 3.0), ("older", 0.05, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "dataset string, submitted double, finished double, modified double")
    assert {r.dataset: (r.status, r.position) for r in tasks.queue_status(df, 10.0).collect()} == {"a": ("running", 1), "b": ("waiting", 2), "old": ("done", None), "older": ("done", None)}
    assert [r.dataset for r in tasks.outdated(df, 1).collect()] == ["older"]
    ran = []
    assert tasks.run_next(df, 10.0, ran.append) == "a" and ran == ["a"] and tasks.run_next(df.limit(0), 10.0, ran.append) is None


def test_queue_turns(spark):
    rows = [("b", 2.0, None, 5.0), *((f"done{i}", float(i), 3.0, 3.0) for i in range(102))]
    df = spark.createDataFrame(rows, "dataset string, submitted double, finished double, modified double")
    said = []
    turn = lambda now, *last: tasks.serve_once(df, now, lambda x: said.append(f"run {x}"), lambda: said.append("update"), lambda x: said.append(f"delete {x}"), *last)
    assert turn(10.0) == ("b", 10.0, 10.0) and sorted(said) == ["delete done0", "delete done1", "run b", "update"]
    said.clear()
    assert turn(20.0, 10.0, 10.0) == ("b", 10.0, 10.0) and said == ["run b"]


def test_stored_tables_follow_their_files(spark, tmp_path):
    from gleaner.session import stored

    made, source = [], str(tmp_path / "source")
    spark.range(5).write.parquet(source)

    def make():
        made.append(1)
        return {"twice": spark.read.parquet(source).selectExpr("id * 2 AS x")}

    get = lambda: sorted(r.x for r in stored(spark, "test", [source], make)["twice"].collect())
    assert get() == get() == [0, 2, 4, 6, 8] and len(made) == 1
    spark.range(5, 6).write.mode("append").parquet(source)
    assert get() == [0, 2, 4, 6, 8, 10] and len(made) == 2


def test_task_files_of_other_shapes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#dataset = x\n#delcode = a = b\n#limit = 1\n#limit = 2\n7 blah\n# dataset = late\n8\n")
    row = readers.read_descriptors(spark, str(tmp_path)).first()
    assert row.header == {"dataset": "x", "delcode": "a = b", "limit": "2"} and row.ids == [7, 8]
    (tmp_path / "a.txt").write_text("#what = 1\n")
    with pytest.raises(Exception, match="no such key"):
        readers.read_descriptors(spark, str(tmp_path)).collect()
    (tmp_path / "a.txt").write_text("#dataset = only\n")
    assert readers.read_descriptors(spark, str(tmp_path)).first().header == {"dataset": "only"}
