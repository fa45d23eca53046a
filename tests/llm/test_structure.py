"""Page extraction, conversation repair and centroid clustering, against plain Python."""

import hashlib
import html
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import extraction, repair, yinyang

# ---- extraction

P1 = "A first paragraph, of some length, which tells what the page is about, at leisure."
P2 = "A second one, hardly shorter, goes on about the same, and ends with a full stop."


def page(*inside, before="", after=""):
    return f"<html><head><title>T</title><script>var a = '<p>no</p>';</script></head><body>{before}{''.join(inside)}{after}</body></html>"


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("no markup &amp; no tags", "no markup & no tags"),
        (page(f"<article><h1>Head</h1><p>{P1}<p>{P2}</article>"), f"Head\n{P1}\n{P2}"),
        (page(f"<div class=story><p>{P1}</p><p>{P2}</p></div>", before="<nav><ul><li><a href=/>x</a></ul></nav><header>site</header>", after="<footer>f</footer>"), f"{P1}\n{P2}"),
        (page(f"<div id=main><p>{P1}</p></div>", after=f"<div id='comments'><p>{P1}</p><p>{P2}</p><p>{P2}</p></div>"), P1),
        (page(f"<article><p>{P1}</p></article>", before="<div class='cookie-notice'><p>We use cookies, and more cookies, and yet more.</p></div>"), P1),
        (page(f"<div class='page has-sidebar'><p>{P1}</p></div>", after="<div class=SideBar><p>Read, this, too, and, that.</p></div>"), P1),
        (page(f"<main><section><p>{P1}</p><p>{P2}</p></section><section><p>{P2}</p></section></main>"), f"{P1}\n{P2}\n{P2}"),
        (page(f"<div><p>{P1}</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>{P2}</p></div>"), f"{P1}\n{P2}"),
        (page(f"<article><p>{P1}</p><ul><li>an item, in words<li>another one</ul><p>See <a href=1>that</a> page.</p></article>"), f"{P1}\nan item, in words\nanother one\nSee that page."),
        (page(f"<article><p>a\n\t b<br>c&nbsp;&lt;d&gt; &amp;amp; &#233;&#x20AC;</p><p>{P1}</p></article>"), f"a b c <d> &amp; é€\n{P1}"),
        (page(f"<form><div><p>{P1}</p></div></form>"), P1),
        (page(f"<div class=comment><p>{P1}</p></div>"), P1),
        (page(f"<div hidden><p>{P1}</p></div><div style='display: none'><p>{P1}</p></div><p>{P2}</p>"), P2),
        (page(f"<article><p>{P1}<!-- <p>no</p> --></p><style>p{{}}</style><textarea><p>no</textarea></article>"), P1),
        (f"<article><p>{P1}</p><script>never ends <p>{P2}</p>", P1),
        (f"<article><p>{P1}</p><!-- never ends <p>{P2}</p>", P1),
        (f"<article><p>{P1}</p><a href=\"never ends <p>{P2}</p>", f"{P1}\n{P2}"),
        (f"<article><p>{P1}</p><p never ends {P2}", P1),
        (page(f'<article><p title="a > b" data-x=\'">\'>{P1}</p></article>'), P1),
        (page(f"<table><tr><td>{P1}<td>{P2}</table>"), f"{P1}\n{P2}"),
        (page(f"<article><p><b>Bold<br><p>{P1}</p></article>"), f"Bold\n{P1}"),
        (page(f"<div><article><p>{P1}</p><p>{P2}</p></article><p>Buy, now.</p><div class=ad>{P2}</div></div>"), f"{P1}\n{P2}\nBuy, now."),
        (page("<h1>Only a heading</h1>"), "Only a heading"),
        (page(f"<article><p>short.</p></article>", before="<div class=ad>An advert, much longer, than all, of it, really.</div>"), "short."),
    ],
)
def test_main_text(source, text):
    assert extraction.main_text(source) == text


def by_element(source):
    """The text of a page's article element, where it holds headings and paragraphs only."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_all_pages_of_a_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extraction.digest(pages).collect()}
    rows = pages.collect()
    assert len(rows) == len(got)
    for r in rows:
        assert got[r.page_id].text == by_element(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_pages_of_odd_kinds(spark):
    rows = [(1, None, None, 5), (1, "u", f"<p>{P1}", 5), (None, "u", "", 5), (1, "u", f"<p>{P1}", 5), (2, "", "😀", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((tuple(r) for r in extraction.digest(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, "u", P1, len(P1)), (None, "u", "", 0), (1, "u", P1, len(P1)), (2, "", "😀", 1)], key=str)
    assert extraction.digest(pages.limit(0)).count() == 0
    assert extraction.extracted(pages, name="main").columns == [*pages.columns, "main"]


@pytest.mark.parametrize("source", ["<div>" * 60_000 + "x", "<b>" * 60_000 + "<p>y</b>", f"<p>{P1}</p>" * 20_000, "<a b='" * 60_000, "&amp" * 200_000, "<" * 200_000, "<article>" * 20_000 + f"<p>{P1}"])
def test_long_pages_take_linear_time(source):
    began = time.perf_counter()
    extraction.main_text(source)
    assert time.perf_counter() - began < 20


@given(st.text(st.sampled_from("<>/!-=\"' abp&;div") | st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_text_is_a_page(source):
    got = extraction.main_text(source)
    assert all(b and b == " ".join(b.split()) for b in got.split("\n")) or got == ""


# ---- repair


def plain_repair(rows, deletion=2):
    """(audit, cost, texts) of (role, text, fault) rows by trying all edits, the states' best audits kept as texts."""
    best = {"": (0, "", ())}

    def put(found, state, new):
        if state is not None and (state not in found or new[:2] < found[state][:2]):
            found[state] = new

    after = lambda state, i: i if re.fullmatch("s?(ua)*u?", {"": "", "s": "s", "u": "u", "a": "ua"}[state] + i) else None
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            more = dict(best)
            for s, (c, a, t) in best.items():
                for i in "ua":
                    put(more, after(s, i), (c + 5, a + "I", (*t, f"{name[i]}:")))
            best = more
        return best

    for role, text, fault in rows:
        found = {}
        for s, (c, a, t) in best.items():
            put(found, s, (c + deletion, a + "D", t))
        if fault not in ("blank", "duplicate"):
            for s, (c, a, t) in inserted(best).items():
                late = 5 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    put(found, after(s, role[:1]), (c + late, a + "K", (*t, f"{role}:{text}")))
                for i in "ua":
                    put(found, after(s, i), (c + late + 1, a + "R", (*t, f"{name[i]}:{text}")))
        best = found
    return min((c, a, t) for s, (c, a, t) in inserted(best).items() if s in ("", "a"))


def plain_digest(turns):
    """The contract's rows of (conv_id, turn, role, text), by walking through them."""
    talks = {}
    for conv, turn, role, text in turns:
        kept = talks.setdefault(conv, [])
        said = lambda v: " " if v is None else str(v)
        role, text, kind = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in talks.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told = set(), []
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            told.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None))
            seen.add((role, text))
        cost, audit, texts = plain_repair(told)
        known = [t for t, _, _ in rows if t is not None]
        count = lambda f: sum(t[2] == f for t in told)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def check_repair(spark, rows):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, fault string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.digest(turns).collect()}
    assert got == plain_digest(rows)
    return got


def test_repair_is_the_cheapest_and_least(spark):
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "assistant", "user", "tool", "", None, "agent"], ["Yes.", "No!", "well", " \t\n", "", None, "Ok?  ", "a.b", "É."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{t} {rng.choice(texts)}") for c in range(150) for t in range(rng.randrange(1, 14))]
    rows += [(c, rng.choice([None, 0, 5, -3]), rng.choice(roles[:3]), rng.choice(texts)) for c in [None, 3, 7] * 6]
    got = check_repair(spark, rows)
    assert len(got) == 151 and any("R" in r[6] for r in got.values()) and any(r[6].startswith("K") for r in got.values())


def test_a_conversation_over_all_partitions(spark):
    """One conversation has most rows, another one row most of the time: both reach over many partitions."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(400)}{rng.choice('.,')}") for t in range(1500)]
    rows += [(8, t % 3, "user", "again.") for t in range(700)] + [(c, 0, "user", "hello.") for c in (1, 2, 9, 10)]
    check_repair(spark, rows)


def test_repaired_turns_are_legal(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c", ""]) + str(t) * rng.randrange(2)) for c in range(40) for t in range(8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    kept = {}
    for r in sorted(repair.repaired(turns).collect(), key=lambda r: (r.place, r.nth)):
        kept.setdefault(r.conv_id, []).append(r.role[0])
    assert len(kept) > 20 and all(re.fullmatch("(s?(ua)+)?", "".join(k)) for k in kept.values())


def test_repair_of_nothing(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert repair.digest(spark.createDataFrame([], kind)).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (row,) = repair.digest(spark.createDataFrame([(1, gone, "user", "Hi.")], kind)).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_long_turns(spark):
    text = ". " * 300_000
    check_repair(spark, [(1, 2, "user", text + "x"), (1, 3, "assistant", text), (2, 1, "user", " " * 500_000)])


def test_inserts_where_deletions_are_dear(monkeypatch):
    """With the contract's costs an insert is never cheapest; with others it often is."""
    monkeypatch.setattr(repair, "DELETE", 20)
    options = {k: [[(s.before, s.cost, repair._CODES[s.code], s) for s in to] for to in repair.steps(*k)] for k in repair.STEPS}
    monkeypatch.setattr(repair, "_OPTIONS", options)
    rng = random.Random(9)
    audits = set()
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), str(k), rng.choice([None, None, "truncated"])) for k in range(rng.randrange(1, 9))]
        walk = repair.Walk(0)
        for role, _, fault in rows:
            walk.add(role[0] if role[0] in "sua" else "", fault == "truncated")
        end = walk.end()
        audit = "".join(s.code for s in walk.back(end)) + "I" * len(repair.ENDS[end][0])
        cost, want, _ = plain_repair(rows, 20)
        assert (walk.cost[end] + repair.ENDS[end][1], audit) == (cost, want)
        audits.add(audit)
    assert sum("I" in a for a in audits) > 50


def test_codes_are_prefix_free_and_ordered():
    codes = sorted(repair._CODES)
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    for pair in itertools.product(codes, repeat=2):
        for other in itertools.product(codes, repeat=2):
            assert ("".join(pair) < "".join(other)) == ([repair._CODES[c] for c in pair] < [repair._CODES[c] for c in other])


# ---- clustering


def lloyd(rows, k=8, rounds=10):
    """Per kept vector (id, cluster, squared distance), and the centroids, with whole numbers of any size."""
    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    hashed = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=hashed)[:k]]
    if not kept:
        return [], []
    x = np.array([v for _, v in kept], object)
    for turn in range(rounds + 1):
        d = np.stack([((x - np.array(c, object)) ** 2).sum(1) for c in centers], 1)
        own = d.astype(object).argmin(1)
        if turn < rounds:
            centers = [[int(s) // int((own == j).sum()) for s in x[own == j].sum(0)] if (own == j).any() else c for j, c in enumerate(centers)]
    return [(i, int(j), int(row[j])) for (i, _), j, row in zip(kept, own, d, strict=True)], centers


def check_clusters(spark, rows):
    vectors = spark.createDataFrame([(i, v, 3, 0.5) for i, v in rows], "vec_id long, embedding array<float>, cluster int, upper double").repartition(3)
    got = yinyang.digest(vectors).collect()
    exact = [(i, v) for i, v in ((r.vec_id, r.embedding) for r in vectors.collect())]
    want, centers = lloyd(exact)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(want, key=str)
    total = sum(d for _, _, d in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()
    return got


def test_clusters_are_lloyds(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] + 0.4 * rng.normal(size=64)).tolist()) for i in range(400)]
    check_clusters(spark, rows)


def test_clusters_of_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    v = lambda: (rng.integers(-2, 3, 64) / 1024).tolist()
    rows = [(i % 40, v()) for i in range(90)] + [(200, [0.0] * 64)] * 60 + [(None, v()), (None, v()), (300, None), (301, [1.0] * 63), (302, []), (303, [float("nan")] + [0.0] * 63), (304, [float("inf")] + [0.0] * 63), (305, [None] + [0.0] * 63)]
    rows += [(306, [100_000.0] + [0.0] * 63)]
    assert len(check_clusters(spark, rows)) == 90 + 60 + 2 + 1


def test_few_vectors_and_none(spark):
    one = (np.arange(64) / 7).tolist()
    assert len(check_clusters(spark, [(5, one), (6, one), (7, [-c for c in one])])) == 3
    assert yinyang.digest(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="too large"):
        yinyang.digest(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).count()


def test_bounds_save_distances():
    rng = np.random.default_rng(6)
    middles = rng.integers(-900, 900, (8, 64))
    x = (middles[rng.integers(0, 8, 3000)] + rng.integers(-60, 60, (3000, 64))).astype(np.int64)
    c = yinyang.Centroids(x[:8].copy(), yinyang.grouped(x[:8]), np.zeros(8))
    cluster, upper, lower, took = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, int(c.group.max()) + 1)), []
    for _ in range(8):
        took.append(yinyang.assigned(c, x, cluster, upper, lower))
        assert (cluster == ((x[:, None] - c.at[None]) ** 2).sum(2).argmin(1)).all()
        c = c.after(np.stack([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c.at[j] for j in range(8)]))
    assert took[0] == 8 * 3000 and took[-1] < 3000


def test_many_groups_of_centroids(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (500, 64))
    rows = spark.createDataFrame([(i, (r / 1024).tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got, at = yinyang.clustered(rows.withColumn("extra", F.lit(1)), k=30, rounds=4)
    own = {r.vec_id: r.cluster for r in got.collect()}
    assert [own[i] for i in range(500)] == ((x[:, None] - at[None]) ** 2).sum(2).argmin(1).tolist()
