"""Sorted ids as variable-length bytes of their gaps, in expressions.

Seven bits a byte, the most significant first; the high bit marks a number's last byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.arrays import let, sums_before


def vb_encode(ids: Column) -> Column:
    """array<int>, ascending and not negative -> binary."""
    gap = F.transform(ids, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(ids, i - 1)))

    def one(g: Column) -> Column:
        more = sum((F.when(g >= 1 << 7 * k, 1).otherwise(0) for k in range(1, 5)), F.lit(0))
        byte = lambda k: F.call_function("shiftright", g, k * 7).bitwiseAND(F.lit(127)) + F.when(k == 0, 128).otherwise(0)
        return F.array_join(F.transform(F.sequence(more, F.lit(0), F.lit(-1)), lambda k: F.lpad(F.hex(byte(k)), 2, "0")), "")

    return F.unhex(F.array_join(F.transform(gap, one), ""))


def vb_decode(data: Column) -> Column:
    """binary -> array<int>."""
    codes = F.regexp_extract_all(F.hex(data), F.lit("(?:[0-7][0-9A-F])*[89A-F][0-9A-F]"), F.lit(0))

    def number(code: Column) -> Column:
        bytes_ = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda at: F.conv(F.substr(code, at, F.lit(2)), 16, 10).cast("int"))
        return F.aggregate(bytes_, F.lit(0), lambda acc, b: acc * 128 + b % 128)

    added = lambda gaps: F.transform(F.arrays_zip(gaps.alias("g"), sums_before(gaps).alias("at")), lambda z: z["at"] + z["g"])
    return let(F.transform(codes, number), added)
