"""Sharding by proportional stratified interleaving (operator 2), native expressions only.

Rows of each source are shuffled by a seeded hash and ranked; all rows are then sorted by
their fractional rank ``(rank - 1/2) / rows of the source`` and cut into shards whose row
counts differ by one at most, so each shard has each source's share.

A hot source is ranked in hash buckets, and the global order in buckets of the fractional
rank, so neither gathers in one task, nor do rows that are equal in all columns; texts are read once and never
shuffled.

Defined results: a null text has no bytes and the checksum of an empty one; a null source is
a source of its own; repeated rows are rows; equal keys are ordered by size and checksum;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Cuts
from gleaner.llm.ranks import buckets_for, group_key, running, shuffle_key

SEED = 11


def interleaved(docs: DataFrame, shards: int = 16, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per row: key, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    total = docs.count()
    buckets = buckets_for(total)
    cuts = Cuts(docs.sparkSession, "shards")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), group_key(F.col(source)).alias("stratum"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("crc"), shuffle_key(seed, F.col(key), F.col(text)).alias("h"))
    rows = cuts.write(rows)
    ranked = running(rows, "stratum", ["id", "size", "crc"], buckets)
    # the fraction of row r (from 0) of n is (2r + 1) / 2n; its bucket is exact in longs
    counts = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    placed = cuts.write(
        ranked.join(counts, "stratum")
        .withColumn("cell", F.expr(f"((2 * before + 1) * {buckets}L) div (2 * n)"))
        .select("id", "size", "crc", "stratum", F.col("before").alias("rank"), ((2 * F.col("before") + 1) / (2 * F.col("n"))).alias("fraction"), "cell")
    )
    cells = placed.groupBy("cell").agg(F.count("*").alias("own"))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("cell", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("cell").orderBy("fraction", "stratum", "rank")
    place = placed.join(offsets, "cell").withColumn("place", F.col("offset") + F.row_number().over(inside) - 1)
    shard = place.withColumn("shard", F.expr(f"(place * {shards}L) div {max(total, 1)}L"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return shard.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int"), (F.col("place") - first).alias("slot"))


def digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    got = interleaved(docs, shards)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same with one global order; checksums by the usual table, made by shifting.
ORACLE_SQL = f"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS stratum, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS x,
    ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents
), summed AS (
  SELECT doc_id, stratum, size, h, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, CAST(2 * j - 1 AS BIGINT), 2))::BIGINT FOR j IN range(1, strlen(x) // 2 + 1)]),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS crc FROM docs, crc
), buckets AS (SELECT count(*) AS total, greatest(64, (count(*) + 16383) // 16384) AS b FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h % b, h, doc_id, size, crc) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM summed, buckets
), placed AS (
  SELECT *, row_number() OVER (ORDER BY ((2 * rank + 1) * b) // (2 * n), (2 * rank + 1) / (2 * n), stratum, rank) - 1 AS place FROM ranked
), cut AS (SELECT *, (place * 16) // total AS k FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(k AS INTEGER) AS shard, CAST(place - (k * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""
