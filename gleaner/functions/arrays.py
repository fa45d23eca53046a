"""Running values over arrays as expressions, in time that grows with the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An array that grows by one element is copied, so it grows in pieces of this length.
PIECE = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element, what ``combine``, which is associative, makes of ``zero`` and all elements before it."""
    last = lambda a: F.element_at(a, -1)

    def grown(items: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, F.array(zero), lambda acc, x: F.array_append(acc, combine(last(acc), value(x))))

    def joined(parts: Column) -> Column:
        return let(grown(parts, last), lambda ahead: F.flatten(F.transform(parts, lambda a, k: F.transform(F.slice(a, 1, F.size(a) - 1), lambda x: combine(F.get(ahead, k), x)))))

    def whole(items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(items)), F.lit(PIECE))
        return let(F.transform(starts, lambda at: grown(F.slice(items, at, PIECE), lambda x: x)), joined)

    return let(values, whole)


def sums_before(values: Column) -> Column:
    """The sum of all elements before each."""
    return running(values, F.lit(0), lambda a, b: a + b)


def placed(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, all) of all matches in ``text``, from 0, ends exclusive, in code points.

    The text split at the pattern and the pattern's matches alternate, so their lengths add
    up to the places.
    """
    said = F.lit(pattern) if isinstance(pattern, str) else pattern
    whole = F.regexp_extract_all(text, said, F.lit(0))
    gaps = F.transform(F.split(text, said, -1), F.length)

    def build(pairs: Column) -> Column:
        before = sums_before(F.transform(pairs, lambda x: x["gap"] + F.length(x["all"])))
        return F.transform(
            F.arrays_zip(pairs.alias("x"), before.alias("b")),
            lambda z: F.struct((z["b"] + z["x"]["gap"]).alias("start"), (z["b"] + z["x"]["gap"] + F.length(z["x"]["all"])).alias("end"), z["x"]["all"].alias("all")),
        )

    return let(whole, lambda w: let(F.arrays_zip(F.slice(gaps, 1, F.size(w)).alias("gap"), w.alias("all")), build))
