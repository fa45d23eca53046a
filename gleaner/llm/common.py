"""What the corpus operators share: readied Python workers, tables, and written intermediates."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import TEXT_BATCH_BYTES, Cuts, byte_count, small_batches

__all__ = ["TEXT_BATCH_BYTES", "Cuts", "byte_count", "give_back", "kind_of", "lean", "marked_rows", "maybe_among", "small_batches", "table", "told_apart", "unused", "without_rows"]

def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def lean(run):
    """A function of Arrow batches that gives memory back when its task ends.

    Workers serve many tasks; without this, what one task's largest batch took stays with them.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Returns freed memory of this process to the system, where the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names that ``df`` does not have, regardless of case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return tuple(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Plan nodes under which a row of a file stays one row.
_ROW_BY_ROW = ("Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "Relation", "DataSourceV2Relation")


def _row_by_row(plan) -> bool:
    below = plan.children()
    return plan.nodeName().split(" ")[0] in _ROW_BY_ROW and below.size() <= 1 and all(_row_by_row(below.apply(i)) for i in range(below.size()))


def told_apart(docs: DataFrame, name: str, cuts: Cuts) -> DataFrame:
    """``docs`` with a column ``name`` (a struct of two longs) that tells its rows apart, and is the same at each reading.

    Rows of files have their file's hash and place in it, so nothing is copied; any other
    table is written first.
    """
    if _row_by_row(docs._jdf.queryExecution().analyzed()):
        with contextlib.suppress(AnalysisException):
            return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("at")))
    return cuts.write(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))))


#: Bits of the map that ``maybe_among`` sends to all tasks (8 MB, whatever the tables are), and of one of its rows.
MAP_BITS, MAP_ROW = 1 << 26, 1 << 15


def _bits(rows: DataFrame, row: str) -> DataFrame:
    """(map_row, words): a bit for the hash of each row's id."""
    h = F.pmod(F.xxhash64(row), F.lit(MAP_BITS))
    placed = rows.select(h.alias("h")).select(F.expr(f"h div {MAP_ROW}").alias("map_row"), F.expr(f"cast((h % {MAP_ROW}) div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("bit"))
    words = placed.groupBy("map_row", "word").agg(F.bit_or("bit").alias("bits")).groupBy("map_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    return words.select("map_row", F.transform(F.sequence(F.lit(0), F.lit(MAP_ROW // 64 - 1)), lambda i: F.coalesce(F.try_element_at("set", i), F.lit(0).cast("long"))).alias("words"))


def marked_rows(docs: DataFrame, row: str, rows: DataFrame, hit: str) -> DataFrame:
    """``docs`` with ``hit``: false where the id surely is not in ``rows``.

    A map of ``MAP_BITS`` bits goes to all tasks; with very many ids it says true more often.
    """
    h, at, words = unused(docs, "map_hash", "map_row", "words")
    bits = _bits(rows, row).withColumnsRenamed({"map_row": at, "words": words})
    hashed = docs.withColumn(h, F.pmod(F.xxhash64(row), F.lit(MAP_BITS))).withColumn(at, F.expr(f"`{h}` div {MAP_ROW}"))
    word = F.get(F.col(words), F.expr(f"cast((`{h}` % {MAP_ROW}) div 64 as int)"))
    found = F.call_function("getbit", word, F.expr(f"cast(`{h}` % 64 as int)")) == 1
    return hashed.join(F.broadcast(bits), at, "left").withColumn(hit, F.coalesce(found, F.lit(False))).drop(h, at, words)


def maybe_among(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``rows``, and few others: what is left to join is small where ``rows`` is.

    A map of ``MAP_BITS`` bits goes to all tasks; with very many ids it lets more others pass.
    """
    (hit,) = unused(docs, "map_hit")
    return marked_rows(docs, row, rows, hit).where(F.col(hit)).drop(hit)


def without_rows(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """``docs`` without those whose id is in ``rows``; only rows that may be among them are shuffled."""
    (hit,) = unused(docs, "map_hit")
    marked = marked_rows(docs, row, rows, hit)
    clear, other = marked.where(~F.col(hit)).drop(hit), marked.where(F.col(hit)).drop(hit)
    return clear.unionByName(other.join(rows.select(row).hint("merge"), row, "left_anti"))
