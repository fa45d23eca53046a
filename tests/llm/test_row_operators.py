"""Operators that judge each row alone: BPE, media, URLs, chat, language."""

import base64
import hashlib
import os
import random
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import bpe, chat, language, media, queries, url_filter

PATH = public_tokenizers.path(queries.TOKENIZER)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@given(st.text(st.sampled_from("aAbtheER's 0\t\x1c\x85éÉΣσİ中😀́<|>.") | st.characters(codec="utf-8", exclude_categories=("Cs", "Cn")), max_size=24))
@settings(max_examples=300, deadline=None)
def test_bpe_is_the_librarys(text):
    lib = Tokenizer.from_file(PATH) if not hasattr(test_bpe_is_the_librarys, "lib") else test_bpe_is_the_librarys.lib
    test_bpe_is_the_librarys.lib = lib
    own = bpe.loaded(PATH)
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_digests(spark, tokenizer):
    long = "antidisestablishment" * 2000
    texts = [(1, "The cat's <|endoftext|>  cat"), (2, None), (3, ""), (1, "The cat's <|endoftext|>  cat"), (None, long)]
    got = bpe.digests(docs(spark, texts), PATH).collect()
    assert len(got) == 5
    for (i, t), r in zip(texts, got, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs(spark, texts), PATH).collect()[0].ids == tokenizer.encode(texts[0][1], add_special_tokens=False).ids
    assert bpe.digests(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 256, 64 * 257, 64 * 513 - 3])
def test_media_round_trip(n):
    data = media.pad(os.urandom(n))
    stored = media.pack(data)
    (track,) = media.inspect(stored)
    assert media.payload(stored, track) == data
    keys = track.keyframes()
    assert track.codec == "raw " and track.seconds == len(data) / 64 / 25
    assert [stored[a:b] for a, b in keys] == [data[i : i + 64] for i in range(0, len(data), 1024)]


def test_media_other_tables():
    """Sizes of their own, 64-bit boxes and offsets, no sync table, a last box without a size."""
    box, full = media.box, media.full
    sizes, chunks = [3, 5, 2, 7], [100, 300]
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stsc", struct.pack(">7I", 2, 1, 3, 1, 2, 1, 1)), full(b"stsz", struct.pack(">2I4I", 0, 4, *sizes)), full(b"co64", struct.pack(">I2Q", 2, *chunks)))
    mdhd = box(b"mdhd", struct.pack(">B3xQQIQI", 1, 0, 0, 1000, 2500, 0))
    trak = box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl)))
    moov = struct.pack(">I4sQ", 1, b"moov", 16 + len(trak)) + trak
    (track,) = media.inspect(box(b"ftyp", b"isom") + moov + struct.pack(">I4s", 0, b"mdat") + bytes(400))
    assert track.codec == "avc1" and track.seconds == 2.5
    assert track.keyframes() == [(100, 103), (103, 108), (108, 110), (300, 307)]
    with pytest.raises(ValueError):
        list(media.walk(b"\0\0\0\x20ftyp"))


def test_media_columns(spark):
    stored = media.pack(media.pad(b"abc" * 700))
    files = spark.createDataFrame([(1, stored), (2, None), (1, stored)], "media_id long, content binary")
    got = media.media_columns(files).collect()
    assert len(got) == 2 and got[0].codec == "raw " and len(got[0].keyframes) == 3
    rows = media.stored_texts(docs(spark, [(1, "é"), (2, None), (3, "é")])).collect()
    padded = media.pad("é".encode())
    assert (rows[0].n_bytes, rows[0].payload_bytes, rows[0].tail_crc32) == (2, 64, zlib.crc32(padded))
    assert rows[0].payload_sha256 == hashlib.sha256(padded).hexdigest()
    assert rows[0][1:] == rows[2][1:] and rows[1].n_bytes == 0 and rows[1].payload_bytes == 64


def test_url_parts_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"),
        ("http://example.net/fr/", "example.net", "/fr/", "net/"),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/"),
        ("https://b.org/fr/x", "b.org", "/fr/x", "org/fr/"),
        ("https://b.org/de/x", "b.org", "/de/x", None),
        ("x://example.com/de/#", "example.com", "/de/", "example.com/de/"),
        ("http://a.net", "a.net", "", None),
        ("http://a.net?x/y", "a.net", "", None),
        ("mailto:a", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
        ("http://É.net/\n/a", "É.net", "/\n/a", "net/"),
    ]
    rows = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(cases)], "page_id long, url string, score int")
    got = {r.page_id: r for r in url_filter.judged(rows).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), cases[i]
        if rule:
            assert got[i].verdict == ("block" if rule in ("net/", "example.com/de/") else "allow") and got[i].score is None
    assert got[9].verdict == got[10].verdict == "block"
    assert url_filter.judged(rows.limit(0)).count() == 0


def test_url_model_is_brute_force():
    ratio = url_filter.Ratio(["aab", "aac"], ["bbb", "bba"])

    def chance(texts, context, char, alphabet):
        if context is None:
            return 1 / alphabet
        shorter = chance(texts, context[1:] if context else None, char, alphabet)
        padded = ["\x02" * url_filter.ORDER + t + "\x03" for t in texts]
        after = [t[i + len(context)] for t in padded for i in range(url_filter.ORDER - len(context), len(t) - len(context)) if t[i : i + len(context)] == context]
        return (after.count(char) + len(set(after)) * shorter) / (len(after) + len(set(after))) if after else shorter

    for context, char in (("\x02\x02aa", "b"), ("aaaa", "a"), ("\x02\x02\x02\x02", "b"), ("zzzz", "q")):
        for m, texts in zip(ratio.models, (["aab", "aac"], ["bbb", "bba"]), strict=True):
            assert m.chance(context, char, 5) == pytest.approx(chance(texts, context, char, 5))
    assert ratio.score("aab") > 0 > ratio.score("bbb")


def test_url_model_on_held_out_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/pages.parquet")
    ruled = url_filter.ruled(pages)
    model = url_filter.fit(ruled)
    fresh = ruled.where("judged is not null").select("judged", "url").orderBy(F.xxhash64("url").desc()).limit(600).collect()
    right = sum((model.score(u) >= model.threshold) == (v == "allow") for v, u in fresh)
    assert right / len(fresh) > 0.9


def test_chat(spark):
    rows = [
        (1, 2, "assistant", "<|turn|>&lt; b"), (1, 1, "user", "a\n"), (1, 3, "assistant", None), (1, 3, "assistant", "x"), (1, 4, None, "<|end|>\n"),
        (2, None, "assistant", "late"), (None, 0, "user", "n"), (2, 1, "us<|text|>er", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.formatted(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.trained_text(F.col("formatted"), F.col("mask"))).collect()}
    assert [tuple(t) for t in got[1].back] == [("user", "a\n"), ("assistant", "<|turn|>&lt; b"), ("assistant", ""), ("assistant", "x"), ("", "<|end|>\n")]
    assert got[1].loss == "<|turn|>&lt; bx" and got[1].formatted.count(chat.OPEN) == 3
    assert sum(m.chars for m in got[1].mask) == len(got[1].formatted)
    assert [tuple(t) for t in got[2].back] == [("assistant", "late"), ("us<|text|>er", "")]
    assert got[None].loss == ""
    assert chat.digest(df.limit(0)).count() == 0


def test_language(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit(1))
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 34 !", "en"), (-3, "", "de"), (None, "the thing and other of that in the thing", None)], "doc_id long, text string, lang string")
    got = language.identified(table.unionByName(odd, allowMissingColumns=True)).collect()
    by = {r.doc_id: r for r in got}
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (-1, -2, -3))
    assert all(0 <= r.score <= 1 for r in got) and by[None].lang_pred in set(truth.values())
    assert not any(r.rejected for r in got if r.doc_id in truth)
    kept = language.recognised(table.unionByName(odd, allowMissingColumns=True))
    assert kept.count() == table.count() + 1
    nothing = language.identified(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_pieces(monkeypatch):
    text = "Étoile, la  mer 12 und die Straße " * 50
    whole = language.grams(text)
    monkeypatch.setattr(language, "PIECE", 7)
    assert (language.grams(text) == whole).all()


def test_language_rejects_gibberish_and_unlearned_languages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    italian = "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura"
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    odd = [" ".join(letters(rng.randint(2, 9)) for _ in range(n)) for n in (20, 40, 400)] + [base64.b64encode(rng.randbytes(n)).decode() for n in (90, 2000)] + [italian, finnish, polish]
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = language.identified(table.unionByName(own, allowMissingColumns=True)).collect()
    assert [r.doc_id for r in got if r.doc_id < 0 and not r.rejected] == []
    held = [r for r in got if r.doc_id >= 0 and r.held_out]
    assert len(held) > 300 and not any(r.rejected for r in held)
