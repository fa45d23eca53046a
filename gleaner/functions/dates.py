"""Dates as YYYYMMDD integers, and ids in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates before this are no limit.
FIRST_DATE = 19650101


def date_key(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def key_date(key: Column) -> Column:
    return F.make_date((key / 10000).cast("int"), (key / 100).cast("int") % 100, key % 100)


def parse_date(text: Column) -> Column:
    """``YYYY/MM/DD`` as a key; null where it is not three numbers, or before 1965; the calendar is not asked."""
    part = lambda i: F.try_element_at(F.split(text, "/"), F.lit(i)).try_cast("int")
    key = part(1) * 10000 + part(2) * 100 + part(3)
    return F.when((F.size(F.split(text, "/")) == 3) & (key >= FIRST_DATE), key)


def date_is_valid(text: Column, today: Column) -> Column:
    """No limit, or strictly before the day before ``today`` by key arithmetic."""
    part = lambda i: F.try_element_at(F.split(text, "/"), F.lit(i)).try_cast("int")
    well = (F.size(F.split(text, "/")) == 3) & part(1).isNotNull() & part(2).isNotNull() & part(3).isNotNull()
    key = parse_date(text)
    return F.coalesce(well & (key.isNull() | (key < date_key(today) - 1)), F.lit(False))


def parse_ids(text: Column) -> Column:
    """All ids of a text that has them between white space."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.cast("bigint"))
