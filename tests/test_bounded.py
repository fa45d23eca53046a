"""Memory and tasks that grow with the input no more than they must."""

import tracemalloc

import pyarrow as pa

from gleaner.operators import cooccur
from gleaner.sources import files


def test_many_aliases_take_few_bytes():
    listed = pa.array([[f"w{k} v{k % 977}"] for k in range(30_000)], pa.list_(pa.string()))
    tracemalloc.start()
    aliases = cooccur.Aliases(listed)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 6 << 20
    assert list(aliases.matches("a w7 v7, w976-V976 w8 v9")) == [(7, 2, 7), (976, 9, 18)]


def test_statements_are_read_in_bounded_batches(tmp_path):
    path = tmp_path / "part.sql"
    said = [f"INSERT INTO t VALUES ({k}, '{'x' * 5000}');" for k in range(3000)]
    path.write_text("".join(f"{s}\n" for s in said))
    batches = list(files.StatementsReader({"path": str(path)}).read(files.Range(str(path), 4, 0)))
    assert all(b.nbytes < 2 * files.CHUNK for b in batches) and len(batches) > 2
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "number", "statement")), strict=True)]
    assert rows == [(4, k, s) for k, s in enumerate(said)]


def test_streams_are_cut_at_the_marks_of_their_manifest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stream")
    docs = spark.range(30_000).selectExpr("id AS pmid", "20200101 AS date_key", "array(1, cast(id % 90 + 2 AS int)) AS features")
    files.write_feature_stream(docs.coalesce(1), path)
    got = files.read_feature_stream(spark, path, part=64 << 10)
    assert got.exceptAll(docs).isEmpty() and got.count() == 30_000
    monkeypatch.setattr(files.Records, "borders", None)  # the heads are not walked on the driver
    reader = files.StreamReader({"path": path, "part": str(64 << 10)})
    ranges = reader.partitions()
    assert len(ranges) > 2 and sum(b.num_rows for r in ranges for b in reader.read(r)) == 30_000
    monkeypatch.setattr(files, "MOST_PARTS", 2)
    assert len(reader.partitions()) <= 3
