"""Numbers and running sums over one order of all rows, or of many groups' rows, without a task that sees all of a group.

Rows are dealt by range of (group, order), sorted in each partition, and written with their places; the
sizes and sums of each partition's part of a group, a row each, give the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import Cuts


def _placed(rows: DataFrame, order: Sequence[Column | str], by: Sequence[str], cuts: Cuts | None) -> DataFrame:
    """The rows, written, with ``_part``, ``_place``, which is ascending in a part, and ``_group``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cuts or Cuts(rows.sparkSession, "order")
    placed = cuts.write(rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_place", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_group", F.struct(*by) if by else F.lit(0))


def _with_offsets(placed: DataFrame, sums: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """``placed`` with, for each name, what all earlier parts of the group sum up to, and ``_first``, the place where the group begins in the part.

    A group has a row for each of its parts in the window.
    """
    own = placed.groupBy("_group", "_part").agg(F.min("_place").alias("_first"), *(F.sum(c).alias(k) for k, c in sums.items()))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select("_group", "_part", "_first", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in sums))
    if not by:
        return placed.join(F.broadcast(offsets), ["_group", "_part"])
    # groups may hold nulls
    told = offsets.withColumnsRenamed({"_group": "_g", "_part": "_p"})
    return placed.join(told, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).drop("_g", "_p")


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str, first: int = 1, cuts: Cuts | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: each row's number in the order, dense from ``first``, in each group of ``by``."""
    got = _with_offsets(_placed(rows, order, by, cuts), {"n": F.lit(1)}, by)
    return got.withColumn(name, (F.col("_n") + F.col("_place") - F.col("_first") + F.lit(first)).cast("int")).drop("_part", "_place", "_group", "_first", "_n")


def tiled(rows: DataFrame, order: Sequence[Column | str], name: str, tiles: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: which of so many runs of each group's order a row is in, from 0; the first runs are one longer."""
    told = numbered(rows, order, "_number", 0, by=by)
    sizes = told.groupBy(F.struct(*by).alias("_g") if by else F.lit(0).alias("_g")).agg(F.count("*").alias("_size"))
    both = told.join(sizes, (F.struct(*by) if by else F.lit(0)).eqNullSafe(F.col("_g")))
    each, more = F.expr(f"_size div {tiles}"), F.col("_size") % tiles
    long = (each + 1) * more  # rows in the longer runs
    tile = F.when(F.col("_number") < long, F.try_divide(F.col("_number"), each + 1)).otherwise(more + F.try_divide(F.col("_number") - long, each))
    return both.withColumn(name, F.floor(tile).cast("int")).drop("_number", "_g", "_size")


def running(rows: DataFrame, order: Sequence[Column | str], sums: Mapping[str, str], cuts: Cuts | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds for each name the sum of a column over the row and all before it in its group of ``by``."""
    upto = Window.partitionBy("_part", "_group").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    got = _with_offsets(_placed(rows, order, by, cuts), {k: F.col(c) for k, c in sums.items()}, by)
    return got.withColumns({k: F.col(f"_{k}") + F.sum(c).over(upto) for k, c in sums.items()}).drop("_part", "_place", "_group", "_first", *(f"_{k}" for k in sums))


def with_next(rows: DataFrame, order: Sequence[Column | str], after: Mapping[str, str], cuts: Cuts | None = None) -> DataFrame:
    """Adds for each name a column of the next row in the order; null at the last."""
    told = numbered(rows, order, "_number", cuts=cuts)
    return told.join(told.select((F.col("_number") - 1).alias("_number"), *(F.col(c).alias(k) for k, c in after.items())), "_number", "left").drop("_number")
