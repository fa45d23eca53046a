"""What operators may not keep: plans whose driver or tasks would hold a table that grows."""

from gleaner.llm import simhash, url_filter


def test_no_table_that_grows_is_broadcast(spark, sf_dir):
    """Fingerprint links and copies are joined by merge: the driver builds no table of documents or links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nodes = simhash.fingerprints(docs).select("fp").distinct()
    for df in (simhash.linked(nodes), simhash.near_duplicates(docs), simhash.copies(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_every_labelled_url_is_learned_from(spark, monkeypatch):
    """The counts are those of all urls that rules judge, however few a bounded sample would take."""
    monkeypatch.setattr(url_filter, "PER_CLASS", 4)
    monkeypatch.setattr(url_filter, "CHARS", 100)
    rows = [f"http://{w}{i}.{end}" for i in range(40) for w, end in (("good", "org/fr/ok"), ("bad", "net/no"))]
    asked = [f"http://{w}{i}x.com" for i in range(9) for w in ("good", "bad")]
    urls = spark.createDataFrame(list(enumerate(rows + asked)), "page_id long, url string")
    by = {v: sorted(u for u in rows if (".org" in u) == (v == "allow")) for v in ("allow", "block")}
    ratio = url_filter.fitted(by["allow"], by["block"])
    got = {r.page_id: r for r in url_filter.judged(urls).collect()}
    for k, u in enumerate(asked, len(rows)):
        assert abs(got[k].score - ratio.score(u)) < 1e-6 and got[k].verdict == ("allow" if ratio.score(u) >= ratio.threshold else "block")
