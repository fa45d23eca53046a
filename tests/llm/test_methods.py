"""Whole operators against plain Python, and the SQL twins of the corpus queries."""

import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ann, chat, language, media, mixing, queries, url_filter
from gleaner.llm.common import Cuts, byte_count, maybe_among, told_apart, without_rows

TABLES = "documents embeddings pages conversations labels".split()


def rows(records, order):
    said = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(said(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, result = queries.QUERIES[name](spark, sf_dir), con.execute(queries.ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    assert rows(df.collect(), [df.columns.index(c) for c in names]) == rows(result.fetchall(), [columns.index(c) for c in names])


# ---- rows told apart


def test_rows_of_files_are_told_apart(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS words").repartition(3).write.parquet(str(tmp_path / "t"))
    made = Cuts(spark, "test")
    for df in (spark.read.parquet(str(tmp_path / "t")).where("id < 90"), spark.read.parquet(str(tmp_path / "t")).unionByName(spark.range(5).selectExpr("id", "id AS words"))):
        told = told_apart(df, "own", made)
        n = df.count()
        assert told.select("own").distinct().count() == n
        assert {(r.id, r.own) for r in told.collect()} == {(r.id, r.own) for r in told.orderBy("words").collect()}
        some = made.write(told.where("id % 10 = 0").select("own"))
        assert {r.id % 10 for r in maybe_among(told, "own", some).collect()} == {0}
        rest = without_rows(told, "own", some)
        assert rest.columns == told.columns and rest.count() == n - some.count() and rest.where("id % 10 = 0").count() == 0
    assert [byte_count(x) for x in ("256m", "4194304", "4194304b", "1g", "?")] == [256 << 20, 4 << 20, 4 << 20, 1 << 30, 0]


# ---- nearest neighbours


def test_ann_recall_over_groups_and_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 300)
    monkeypatch.setattr(ann, "QUERIES", 16)
    path = f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet"
    table = pq.read_table(path)
    ids, x = table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist(), float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(spark.read.parquet(path), F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[i]
        near[i] = -np.inf
        want = set(ids[np.lexsort((ids, -near))[:5]].tolist())
        hits, total = hits + len(want & set(got[ids[i]].values())), total + 5
        assert sorted(got[ids[i]]) == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * total


# ---- urls


def test_url_judgement_is_brute_force(spark, sf_dir):
    """The sample, the calibration, the threshold and every verdict."""
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").select("page_id", "url")
    ruled = url_filter.ruled(pages)
    place = F.pmod(F.xxhash64(F.lit("urls"), F.col("url")), F.lit(1 << 30))
    by = {v: sorted({r.url for r in ruled.where((F.col("judged") == v) & (F.col("url") != "")).collect()}) for v in ("allow", "block")}
    assert url_filter.training_sample(ruled) == by and place is not None
    train = {v: [u for i, u in enumerate(x) if i % 4] for v, x in by.items()}
    ratio = url_filter.Ratio(train["allow"], train["block"])
    tests = {v: [ratio.score(u) for i, u in enumerate(x) if i % 4 == 0] for v, x in by.items()}

    def unfair(t):
        return abs(sum(s < t for s in tests["allow"]) / len(tests["allow"]) - sum(s >= t for s in tests["block"]) / len(tests["block"]))

    threshold = min(sorted({*tests["allow"], *tests["block"]}), key=unfair)
    seen = set()
    for r in url_filter.judged(pages).join(pages, "page_id").collect():
        if r.rule is None:
            want = "allow" if r.url and ratio.score(r.url) >= threshold else "block"
            assert r.verdict == want, r
            seen.add(want)
    assert seen


def test_copies_of_urls_change_no_verdict(spark):
    urls = [f"http://a.net/x{i}" for i in range(10)] + [f"http://b.org/fr/y{i}" for i in range(10)] + [f"http://c.com/{w}{i}" for i in range(5) for w in "xy"]
    once = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    many = once.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("again")
    verdicts = lambda df: {(r.page_id, r.verdict) for r in url_filter.judged(df).distinct().collect()}
    assert verdicts(once) == verdicts(many)
    assert url_filter.fit(url_filter.ruled(many)) is not None and "block" in {v for i, v in verdicts(many) if i >= 20}


# ---- chat


def test_whole_urls_are_learned_from(spark, monkeypatch):
    """What tells two long urls apart stands at their ends; the characters of all bound the sample."""
    long = "x" * 6000
    rows = [(i, f"http://a{i}.{'net' if i % 2 else 'org/fr'}/{long}{'bad' if i % 2 else 'good'}{i % 7}") for i in range(40)]
    urls = spark.createDataFrame(rows, "page_id long, url string")
    sample = url_filter.training_sample(url_filter.ruled(urls))
    assert {v: len(u) for v, u in sample.items()} == {"allow": 20, "block": 20} and all(len(u) > 6000 for us in sample.values() for u in us)
    monkeypatch.setattr(url_filter, "CHARS", 20_000)
    assert {len(u) for u in url_filter.training_sample(url_filter.ruled(urls)).values()} == {3}
    monkeypatch.setattr(url_filter, "CHARS", 5_000)
    assert not any(url_filter.training_sample(url_filter.ruled(urls)).values())


def test_chat_digest_is_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(-5, 1, "user", "a"), (-5, 2, "assistant", None), (-5, 3, "assistant", "é <|end|>\n&lt;"), (-6, 1, None, "<|turn|>"), (-7, 1, "assistant", "")]
    talks = {}
    for r in table.unionByName(spark.createDataFrame(odd, table.schema)).collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = chat.digest(table.unionByName(spark.createDataFrame(odd, table.schema))).collect()
    assert len(got) == len(talks)
    for r in got:
        turns = sorted(talks[r.conv_id])
        trained = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(trained), sha(trained))


# ---- languages


def test_language_is_the_nearest_centroid(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(table, language.fold())
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in language.identified(table).collect():
        counts = {}
        for i in np.flatnonzero(n := language.grams(texts[r.doc_id])):
            counts[i] = np.log1p(n[i]) * model.idf[i]
        size = np.sqrt(sum(v * v for v in counts.values()))
        near = [sum(v / size * float(c[i]) for i, v in counts.items()) for c in model.centroids]
        k = int(np.argmax(near))
        assert r.lang_pred == model.languages[model.owner[k]] and r.score == pytest.approx(near[k], abs=1e-4)


def test_language_learns_from_copies_too(spark):
    """Many copies of one text, or of a null id, leave it in the sample."""
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    texts = [(" ".join(word("abcde") for _ in range(30)), "x"), (" ".join(word("mnopq") for _ in range(30)), "y")]
    many = spark.createDataFrame([(None, t, k) for t, k in texts], "doc_id long, text string, lang string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("n")
    sample = language.training_sample(many, F.lit(False), "doc_id", "lang", "text").collect()
    assert sorted(r.lang for r in sample) == ["x", "y"]


# ---- mixing


def test_a_thousand_languages(spark):
    """Each language has words of its own letters' pairs; only centroids and floors reach the driver."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(1000):
        own = ["".join(rng.choices(letters, k=4)) for _ in range(6)]
        rows += [(3 * (3 * k + j), " ".join(rng.choices(own, k=30)), f"l{k:04}") for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(False))
    assert len(model.languages) == 1000 and model.languages == sorted(model.languages) and len(model.floors) == 1000
    assert list(model.owner) == sorted(model.owner) and len(model.centroids) == len(model.owner)
    got = model.predict([t for _, t, _ in rows[:300]])
    assert sum(g[0] == r[2] for g, r in zip(got, rows, strict=False)) > 290
    assert language.fit(docs.limit(0), F.lit(False)).languages == []


def test_the_schedule_decides_what_is_taken(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    plain = {tuple(r) for r in mixing.mix(docs)[0].select("doc_id", "taken", "first_slot").collect()}
    other = {tuple(r) for r in mixing.mix(docs, golden=2 * 0x3504F333 + 1)[0].select("doc_id", "taken", "first_slot").collect()}
    assert plain != other and {t[:2] for t in plain} != {t[:2] for t in other}
    # without points that move, the first source alone is met
    still, _ = mixing.mix(docs, golden=0)
    taken = {r.source: r.n for r in still.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert taken["b"] == taken["c"] == 0 and taken["a"] > 0


def test_points_are_the_golden_ratios(spark):
    shares = spark.createDataFrame([("a", 0, 1 << 31), ("b", 1 << 31, 3 << 30), ("c", 3 << 30, 1 << 32)], "stratum string, low long, high long")
    got = {r.slot: (r.stratum, r["rank"]) for r in mixing.schedule(shares, 9000, 3).collect()}
    ranks = {"a": 0, "b": 0, "c": 0}
    for i in range(9000):
        point = i * mixing.GOLDEN % mixing.ONE / mixing.ONE
        s = "a" if point < 0.5 else "b" if point < 0.75 else "c"
        assert got[i] == (s, ranks[s])
        ranks[s] += 1


def test_mixed_documents_come_in_the_schedules_order(spark):
    docs = spark.createDataFrame([(i, f"d{i} " * (i % 9), "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    first = {r.doc_id: r.first_slot for r in mixing.mix(docs)[0].collect() if r.taken}
    seen = []
    for r in mixing.mixed_documents(docs).collect():
        if r.doc_id not in seen:
            seen.append(r.doc_id)
    assert seen == sorted(first, key=first.get)


# ---- media


def fragmented():
    """A movie of two fragments: one names all, the other uses defaults."""
    box, full, pack = media.box, media.full, struct.pack
    stbl = box(b"stbl", full(b"stsd", pack(">I", 1), box(b"avc1", bytes(78))), full(b"stsz", pack(">2I", 0, 0)), full(b"stco", pack(">I", 0)), full(b"stsc", pack(">I", 0)))
    track = box(b"trak", full(b"tkhd", pack(">3I", 0, 0, 7)), box(b"mdia", full(b"mdhd", pack(">4I", 0, 0, 1000, 0)), box(b"minf", stbl)))
    head = box(b"ftyp", b"isom") + box(b"moov", track, box(b"mvex", full(b"trex", pack(">5I", 7, 1, 40, 6, media.NO_SYNC))))
    runs = pack(">iI", 0, 2) + pack(">3I", 40, 5, 0) + pack(">3I", 60, 9, media.NO_SYNC)

    def fragment(header, run_flags, body):
        inner = lambda off: box(b"moof", full(b"mfhd", pack(">I", 1)), box(b"traf", header, full(b"trun", body(off), flags=run_flags)))
        return inner(len(inner(0)) + 8)

    one = fragment(full(b"tfhd", pack(">I", 7), flags=media.BASE_IS_MOOF), media.DATA_OFFSET | media.DURATIONS | media.SIZES | media.FLAGS, lambda off: pack(">Ii", 2, off) + runs[8:]) + box(b"mdat", b"a" * 5 + b"b" * 9)
    two = fragment(full(b"tfhd", pack(">I", 7), flags=media.BASE_IS_MOOF), media.DATA_OFFSET | media.FIRST_FLAGS, lambda off: pack(">IiI", 3, off, 0)) + box(b"mdat", b"c" * 6 + b"d" * 6 + b"e" * 6)
    return head + one + two


def test_fragments():
    data = fragmented()
    (track,) = media.inspect(data)
    assert (track.number, track.codec, track.sizes.tolist(), track.sync.tolist()) == (7, "avc1", [5, 9, 6, 6, 6], [0, 2])
    assert track.seconds == (40 + 60 + 3 * 40) / 1000
    assert media.payload(data, track) == b"a" * 5 + b"b" * 9 + b"c" * 6 + b"d" * 6 + b"e" * 6
    assert [data[a:b] for a, b in track.keyframes()] == [b"a" * 5, b"c" * 6]


def test_malformed_files_are_rows_with_an_error(spark):
    good = media.pack(media.pad(b"abc" * 700))
    late = good.replace(struct.pack(">2I", 3, 1), struct.pack(">2I", 3, 9999), 1)  # a sync sample behind the table
    rng = random.Random(5)
    cut = [good[: rng.randrange(1, len(good))] for _ in range(60)]
    noise = [bytes(b ^ (rng.random() < 0.01) << rng.randrange(8) for b in good) for _ in range(60)]
    files = [good, late, fragmented(), None, b"", *cut, *noise]
    df = spark.createDataFrame(list(enumerate(files)), "media_id long, content binary")
    got = media.media_columns(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.media_id, []).append(r)
        assert (r.error is None) == (r.codec is not None)
    assert by[0][0].error is None and by[1][0].error and by[2][0].samples == 5 and 3 not in by and 4 not in by


def test_media_digest_is_brute_force(spark):
    """The stored form's digest and the feature, from the layout of the file."""
    text = "é" * 3000
    data = text.encode()
    stored = media.pack(media.pad(data))
    at = stored.index(b"mdat") + 4
    frames = -(-len(data) // 64)
    keys = [(at + 64 * i, at + 64 * i + 64) for i in range(0, frames, media.SYNC)]
    ranges = ",".join(f"{a}-{b}" for a, b in keys)
    feature = f"codec=raw;seconds={frames / 25:.2f};samples={frames};keyframes={len(keys)};first={keys[0][0]}-{keys[0][1]};last={keys[-1][0]}-{keys[-1][1]};ranges={zlib.crc32(ranges.encode()):08x}"
    (row,) = media.stored_texts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    padded = data + bytes(-len(data) % 64)
    assert tuple(row) == (1, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
    assert stored[at:] == padded
