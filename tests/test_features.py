"""Feature functions on the golden article and the adversarial string."""

import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import codec, dates, text
from gleaner.operators import features
from gleaner.sources import readers

#: A string of odd signs, and below the article and words that must come out. (Fixed values.)
STRING = "335-349 EU-Ses\n[ZC ad]. A/V-ATP +85.32% Nebø n=>3 -ORF's 2,3-zn(ncs)2 st--foc :-Foc:\n-a-3.-b qe-- (RS) M.G.T. (orth)"


@pytest.fixture(scope="module")
def article(spark):
    row = (
        1, "TTT1 DDD1", "AAA1. AAA2-FFF2 QQQ2 JJJ1 TTT1", "JJJ1", "III1", datetime.date(2000, 6, 29), 1999,
        [("DDD1", []), ("DDD2", []), ("DDD3", ["QQQ1", "QQQ2"]), ("DDD6", ["QQQ2"])], [("FFF1", "LLL1"), ("FFF2", "LLL2")],
    )
    empty = (2, None, None, None, None, None, None, None, None)
    return spark.createDataFrame([row, empty], readers.ARTICLE)


def names(df, ftype=None):
    return sorted(r.fname for r in df.collect() if r.pmid == 1 and (ftype is None or r.ftype == ftype))


def test_headings_and_authors(article):
    rows = features.mqi(article)
    assert names(rows, "mesh") == ["DDD1", "DDD2", "DDD3", "DDD6"]
    assert names(rows, "qual") == ["QQQ1", "QQQ2"]
    assert names(rows, "issn") == ["III1"]
    assert names(features.author(article)) == ["fff1 lll1", "fff2 lll2"]
    assert {r.pmid for r in rows.collect()} == {1}


def test_unions(article):
    assert names(features.wmqia(article), "w") == ["AAA1", "AAA2-FFF2", "DDD1", "JJJ1", "QQQ2", "TTT1"]
    assert names(features.wmqia_filt(article), "w") == ["AAA1", "AAA2-FFF2", "JJJ1", "TTT1"]
    assert names(features.raw_all(article)) == sorted("AAA1. AAA2-FFF2 DDD1 DDD2 DDD3 DDD6 JJJ1 LLL1 LLL2 QQQ1 QQQ2 TTT1".split())
    assert names(features.raw_word(article)) == sorted("AAA1. AAA2-FFF2 DDD1 JJJ1 QQQ2 TTT1".split())
    with pytest.raises(KeyError):
        features.extract(article, "none")


@pytest.mark.parametrize(("make", "expected"), [
    (lambda t, a: text.words(t, a, stopwords=STOP), "2,3-zn(ncs)2 A-3.-b Ad EU-Ses Foc M.G.T Nebø ORF Orth Qe RS St V-ATP ZC"),
    (lambda t, a: text.words(t, a, fold=True, stopwords=STOP), "2,3-zn(ncs)2 a-3.-b ad eu-ses foc m.g.t nebø orf orth qe rs st v-atp zc"),
    (lambda t, a: text.words(t, a, numbers=True, stopwords=STOP), "335-349 85.32 2,3-zn(ncs)2 A-3.-b Ad EU-Ses Foc M.G.T Nebø ORF Orth Qe RS St V-ATP ZC"),
    (lambda t, a: text.words_strip(t, a, stopwords=STOP), "32 335 349 85 ad atp eu foc ncs nebø orf orth qe rs ses st zc zn"),
    (lambda t, a: text.words_raw(t, a, stopwords=STOP), "(RS) (orth) +85.32% -ORF's -a-3.-b 2,3-zn(ncs)2 335-349 :-Foc: A/V-ATP EU-Ses M.G.T. Nebø [ZC ad]. n=>3 qe-- st--foc"),
])
def test_words(spark, make, expected):
    df = spark.createDataFrame([("", STRING)], "t string, a string")
    assert sorted(df.select(make(F.col("t"), F.col("a")).alias("w")).first().w) == sorted(expected.split(" "))


STOP = ("the", "of")


def test_words_edge_cases(spark):
    df = spark.createDataFrame([(None, None), ("The OF the", None), ("éé éeé x", "ß- ßb")], "t string, a string")
    got = [sorted(r.w) for r in df.select(text.words(F.col("t"), F.col("a"), stopwords=STOP).alias("w")).collect()]
    assert got == [[], [], ["ßb"]]
    assert sorted(df.select(text.words(F.col("t"), F.col("a"), numbers=True, stopwords=STOP).alias("w")).collect()[2].w) == sorted(["Éé", "Éeé", "ßb"])
    assert [len(r.w) for r in df.select(text.words_strip(F.col("t"), F.col("a")).alias("w")).collect()][0] == 0


def test_codec(spark):
    ids = [[1, 3], [2, 3, 5434, 3243232], [5, 10, 15], [], [0, 127, 128, 16383, 2**31 - 1], None]
    df = spark.createDataFrame([(x,) for x in ids], "ids array<int>")
    rows = df.withColumn("code", codec.vb_encode(F.col("ids"))).withColumn("back", codec.vb_decode(F.col("code"))).collect()
    assert [r.back for r in rows] == ids
    assert bytes(rows[0].code) == b"\x81\x82" and bytes(rows[4].code)[:3] == b"\x80\xff\x81"


def test_dates(spark):
    df = spark.createDataFrame([("2001/02/03",), ("1964/12/31",), ("x",), ("2020/01/09",), ("2020/01/08",), (None,)], "t string")
    today = F.lit("2020-01-10").cast("date")
    got = df.select(dates.parse_date(F.col("t")).alias("k"), dates.date_is_valid(F.col("t"), today).alias("ok")).collect()
    assert [r.k for r in got] == [20010203, None, None, 20200109, 20200108, None]
    assert [r.ok for r in got] == [True, True, False, False, True, False]
    row = spark.createDataFrame([(" 12 34\n56 ",)], "s string").select(dates.parse_ids(F.col("s")).alias("i"), dates.key_date(F.lit(20000629)).alias("d")).first()
    assert row.i == [12, 34, 56] and row.d == datetime.date(2000, 6, 29)


def test_sentences(spark):
    said = "Mr. A met Dr. B. It was 3.5 cm. really? Yes! No... so. Then\nend."
    df = spark.createDataFrame([(said,), ("",)], "t string")
    rows = df.select(text.sentences(F.col("t")).alias("s")).collect()
    assert [s.sentence for s in rows[0].s] == ["Mr. A met Dr. B. ", "It was 3.5 cm. really? ", "Yes! ", "No... so. ", "Then end."]
    assert all(s.end - s.start == len(s.sentence) for s in rows[0].s) and rows[0].s[-1].end == len(said)
    assert [s.sentence for s in rows[1].s] == [""]
    joined = spark.createDataFrame([("T", "A"), ("T.", "A"), (None, "A"), ("T", None)], "t string, a string").select(text.article_text(F.col("t"), F.col("a")).alias("x")).collect()
    assert [r.x for r in joined] == ["T. A", "T. A", "A", "T."]


def plain_sentences(said):
    """The rule word by word: each with the white space behind it, ended where it says."""
    words = re.findall(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+", said)
    out, now = [], ""
    for word, ahead in zip(words, [*words[1:], ""], strict=False):
        body = word.rstrip(" \t\n\x0b\f\r")
        stops = len(body) - len(body.rstrip("."))
        now += word.replace("\n", " ")
        title = stops == 1 and body[:-1].endswith(text.TITLES)
        if body != word and body and (body[-1] in "!?" or (stops % 3 and not title and not "a" <= ahead[:1] <= "z")):
            out.append(now)
            now = ""
    return [*out, now]


@given(st.lists(st.lists(st.sampled_from([*"aA. .?!\n\t\ue000😀|é", "Mr.", "...", "Prof. ", "Ph"]), max_size=14).map("".join), min_size=1, max_size=30))
@settings(max_examples=25, deadline=None)
def test_sentences_are_the_rules(spark, said):
    rows = spark.createDataFrame([(s,) for s in said], "t string").select("t", text.sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [x.sentence for x in r.s] == plain_sentences(r.t), r.t
        assert all(r.t[x.start : x.end].replace("\n", " ") == x.sentence for x in r.s)


def test_sentences_of_odd_texts(spark):
    said = ["\ue000. Yes.\ue000 No", "Wait.... So", "Wait... So", "Six...... So", "Five..... So", None, "x. " * 30_000, ". " * 2]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select(text.sentences(F.col("t")).alias("s")).collect()
    got = [r.s and [x.sentence for x in r.s] for r in rows]
    assert got[:6] == [["\ue000. ", "Yes.\ue000 No"], ["Wait.... ", "So"], ["Wait... So"], ["Six...... So"], ["Five..... ", "So"], None]
    assert got[6] == ["x. " * 30_000, ""] and got[7] == [". ", ". ", ""]


def test_running_values(spark):
    from gleaner.functions.arrays import placed, running, sums_before

    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 128, 129, 1000)], "a array<int>")
    for r in df.select("a", sums_before(F.col("a")).alias("s"), running(F.col("a"), F.lit(5), F.greatest).alias("m")).collect():
        assert r.s == [sum(r.a[:i]) for i in range(len(r.a))]
        assert r.m == [max([5, *r.a[:i]]) for i in range(len(r.a))]
    said = spark.createDataFrame([("é ab c😀 ab",), ("",), ("x",)], "t string").select(placed(F.col("t"), "ab").alias("p")).collect()
    assert [[tuple(x) for x in r.p] for r in said] == [[(2, 4, "ab"), (8, 10, "ab")], [], []]
