"""Result tables: filter, sort, invert, tag, page, and the columns of a printed citation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """Conditions on results, all together; an empty pattern is no condition.

    Dates are ``YYYY.MM.DD`` strings, patterns are matched without regard to case.
    """

    minscore: float | None = None
    mindate: str = "1900.01.01"
    maxdate: str = "2100.12.31"
    title: str = ""
    title_or_abstract: str = ""
    exclude: str = ""
    journal: str = ""
    authors: str = ""

    def condition(self) -> Column:
        """On columns score, date, title, abstract, journal, authors (rendered)."""
        empty = F.lit("")
        text = F.concat_ws(" ", F.coalesce("title", empty), F.coalesce("abstract", empty))
        keep = F.col("date").between(self.mindate, self.maxdate)
        if self.minscore is not None:
            keep = keep & (F.col("score") >= self.minscore)
        for pattern, column in ((self.title, F.col("title")), (self.title_or_abstract, text), (self.journal, F.col("journal")), (self.authors, F.col("authors"))):
            if pattern:
                keep = keep & F.coalesce(column, empty).rlike(f"(?i){pattern}")
        if self.exclude:
            keep = keep & ~text.rlike(f"(?i){self.exclude}")
        return keep


def rendered(results: DataFrame) -> DataFrame:
    """rank, score, pmid, date, authors, abstract, title, journal as a citation prints them."""
    people = F.transform("authors", lambda a: F.concat_ws(" ", a["initials"], a["lastname"]))
    return results.select(
        "rank", F.format_string("%.2f", "score").alias("shown_score"), "score", "pmid", F.date_format("date_completed", "yyyy.MM.dd").alias("date"),
        F.array_join(people, ", ").alias("authors"), "abstract", "title", F.coalesce("journal", "issn").alias("journal"),
    )


def visible(rows: DataFrame, chosen: Filter) -> DataFrame:
    """Adds ``visible``, or narrows it where it is there already."""
    keep = chosen.condition()
    return rows.withColumn("visible", F.col("visible") & keep if "visible" in rows.columns else keep)


def inverted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("visible", ~F.col("visible"))


def surname() -> Column:
    """Last word of the first author; null without authors."""
    found = F.regexp_extract(F.substring_index("authors", ",", 1), r"(\S+)\s*\z", 1)
    return F.when(found != "", found)


def sorted_by(rows: DataFrame, order: str) -> DataFrame:
    """By rank, date (latest first), journal, or first author (none last); rank breaks ties."""
    orders = {"rank": [], "date": [F.desc("date")], "journal": [F.asc_nulls_last("journal")], "author": [surname().asc_nulls_last()]}
    return rows.orderBy(*orders[order], "rank")


def tagged(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds ``tag`` from a (pmid, tag) table: 0, 1, or null where there is none."""
    return rows.join(tags.select("pmid", "tag").dropDuplicates(["pmid"]), "pmid", "left")


def tag_lines(rows: DataFrame) -> DataFrame:
    """(value): ``pmid,score,tag`` with a blank for no tag."""
    return rows.select(F.concat_ws(",", F.col("pmid").cast("string"), F.format_string("%.2f", "score"), F.coalesce(F.col("tag").cast("string"), F.lit(" "))).alias("value"))


def read_tags(lines: DataFrame) -> DataFrame:
    """(value) -> (pmid, score, tag)."""
    part = lambda i: F.get(F.split("value", ","), F.lit(i))
    return lines.where("trim(value) <> ''").select(part(0).cast("long").alias("pmid"), part(1).try_cast("double").alias("score"), F.trim(part(2)).try_cast("int").alias("tag"))


def paged(results: DataFrame, perfile: int) -> DataFrame:
    """Adds ``page`` from 0; a last page of less than half a page joins the one before."""
    total = results.agg(F.count("*").alias("_n"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("_n") / perfile) - F.when(F.col("_n") % perfile == 0, 0).otherwise((F.col("_n") % perfile < perfile // 2).cast("int")))
    return results.crossJoin(F.broadcast(total)).withColumn("page", F.least(F.floor((F.col("rank") - 1) / perfile), pages - 1).cast("int")).drop("_n")


def page(paged_rows: DataFrame, number: int) -> DataFrame:
    return paged_rows.where(F.col("page") == number).orderBy("rank")


def joined_ids(rows: DataFrame, condition: Column | str = "visible") -> DataFrame:
    """(ids): the ids of chosen rows as one comma list, by rank. For a page or a tag list, which are small."""
    chosen = rows.where(condition).agg(F.array_sort(F.collect_list(F.struct("rank", "pmid"))).alias("all"))
    return chosen.select(F.array_join(F.transform("all", lambda r: r["pmid"].cast("string")), ",").alias("ids"))
