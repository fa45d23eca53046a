"""Ranks and running sums within groups, without gathering a group into one task.

Rows are dealt into buckets by a hash of their key, so a hot group spreads over many
buckets. Counts and sums of the buckets give each bucket its offset; a window inside a
bucket does the rest. The order inside a group is by bucket and hash: a seeded shuffle.
Rows with one key share its hash; where that crowds a bucket, each of them gets a hash of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket is meant to hold where a group has all rows.
BUCKET_ROWS, LEAST_BUCKETS = 16384, 64
#: A bucket with so many times its rows is crowded; a key with more rows than this in it is hot.
CROWDED, HOT = 4, 4096


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def shuffle_key(seed: int, key: Column, text: Column) -> Column:
    """60 bits of md5 as a long; SQL engines agree on it. Nulls count as empty.

    The text counts too, so different texts under one key, or under null, have places of their own.
    """
    whole = F.coalesce(text, F.lit(""))
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(whole))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def group_key(value: Column) -> Column:
    """Never null, and different for each value and null."""
    return F.coalesce(F.concat(F.lit("s"), value.cast("string")), F.lit("n"))


def without_hot_keys(rows: DataFrame, group: str, buckets: int, row: str) -> DataFrame:
    """``rows`` with hashes ``h`` of their own for those whose key crowds a bucket; ``row`` tells rows apart.

    Buckets are counted by partial sums; only rows of crowded ones are counted by key.
    """
    dealt = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    crowded = dealt.groupBy(group, "bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED * BUCKET_ROWS).select(group, "bucket")
    if crowded.isEmpty():
        return rows
    hot = dealt.join(crowded, [group, "bucket"], "left_semi").groupBy(group, "h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(group, "h", F.lit(True).alias("hot"))
    own = F.pmod(F.xxhash64("h", row), F.lit(1 << 60))
    return rows.join(hot, [group, "h"], "left").withColumn("h", F.when(F.col("hot"), own).otherwise(F.col("h"))).select(*rows.columns)


def running(rows: DataFrame, group: str, order: list[str], buckets: int, value: str | None = None, row: str = "row") -> DataFrame:
    """Adds ``before``: the sum of ``value`` (or the number) of the group's earlier rows.

    Needs a column ``h``, the shuffled place, and ``row``, which tells rows apart; rows of one bucket are ordered
    by ``h`` and ``order``. ``rows`` is read several times and must give the same rows each time.
    """
    rows = without_hot_keys(rows, group, buckets, row)
    dealt = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    each = F.col(value) if value else F.lit(1)
    sums = dealt.groupBy(group, "bucket").agg(F.sum(each).alias("own"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "bucket", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(group, "bucket").orderBy("h", *order).rowsBetween(Window.unboundedPreceding, -1)
    got = dealt.join(offsets, [group, "bucket"])
    return got.withColumn("before", F.col("offset") + F.coalesce(F.sum(each).over(inside), F.lit(0))).drop("bucket", "offset")
