"""Sources: citation XML, id and score lists, drug tables, task descriptors, article tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import TASK_KEYS

#: The article table. Any field may be null.
ARTICLE = (
    "pmid long, title string, abstract string, journal string, issn string, date_completed date, pubyear int, "
    "meshterms array<struct<descriptor:string,qualifiers:array<string>>>, authors array<struct<initials:string,lastname:string>>"
)
ARTICLE_COLUMNS = ("pmid", "title", "abstract", "journal", "issn", "date_completed", "pubyear", "meshterms", "authors")

#: What of a citation record is read; everything else is pruned by the parser.
_TEXT = "struct<_VALUE:string>"
CITATION = (
    "_Status string, PMID struct<_VALUE:long>, "
    "DateCompleted struct<Year:int,Month:int,Day:int>, "
    f"Article struct<ArticleTitle:{_TEXT},Abstract:struct<AbstractText:array<{_TEXT}>>,"
    "Journal:struct<ISSN:struct<_VALUE:string>,JournalIssue:struct<PubDate:struct<Year:int>>>,"
    "AuthorList:struct<Author:array<struct<Initials:string,LastName:string>>>>, "
    "MedlineJournalInfo struct<MedlineTA:string>, "
    "MeshHeadingList struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>,QualifierName:array<struct<_VALUE:string>>>>>"
)


def citation_articles(records: DataFrame) -> DataFrame:
    """Parsed citation records -> article rows; records that are not final are skipped. A column ``file`` stays."""
    date = F.col("DateCompleted")
    heading = lambda m: F.struct(m["DescriptorName"]["_VALUE"].alias("descriptor"), F.coalesce(F.transform(m["QualifierName"], lambda q: q["_VALUE"]), F.array().cast("array<string>")).alias("qualifiers"))
    author = lambda a: F.struct(a["Initials"].alias("initials"), a["LastName"].alias("lastname"))
    return records.where(F.col("_Status") == "MEDLINE").select(
        F.col("PMID._VALUE").alias("pmid"),
        F.col("Article.ArticleTitle._VALUE").alias("title"),
        F.get("Article.Abstract.AbstractText", F.lit(0))["_VALUE"].alias("abstract"),
        F.col("MedlineJournalInfo.MedlineTA").alias("journal"),
        F.col("Article.Journal.ISSN._VALUE").alias("issn"),
        F.when(date.isNotNull(), F.try_make_timestamp(date["Year"], date["Month"], date["Day"], F.lit(0), F.lit(0), F.lit(0)).cast("date")).alias("date_completed"),
        F.col("Article.Journal.JournalIssue.PubDate.Year").alias("pubyear"),
        F.coalesce(F.transform("MeshHeadingList.MeshHeading", heading), F.array().cast("array<struct<descriptor:string,qualifiers:array<string>>>")).alias("meshterms"),
        F.coalesce(F.transform("Article.AuthorList.Author", author), F.array().cast("array<struct<initials:string,lastname:string>>")).alias("authors"),
        *(c for c in records.columns if c == "file"),
    )


def read_citations(spark: SparkSession, path: str | list[str], row_tag: str = "MedlineCitation") -> DataFrame:
    """Citation XML, compressed or not. A compressed file cannot be split: one task reads it."""
    return citation_articles(spark.read.format("xml").option("rowTag", row_tag).schema(CITATION).load(path))


def read_citation_directory(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """A directory's ``*.xml`` and ``*.xml.gz``; files whose base name is in ``seen`` (name) are skipped.

    Adds ``file``. For continuous use prefer ``streaming.ingest``, which tracks files itself.
    """
    raw = spark.read.format("xml").option("rowTag", "MedlineCitation").option("pathGlobFilter", "{*.xml,*.xml.gz}").schema(CITATION).load(path)
    raw = raw.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    if seen is not None:
        raw = raw.join(seen.select(F.col("name").alias("file")), "file", "left_anti")
    return citation_articles(raw)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    tokens = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(tokens.alias("t"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pmid): the first token of each line; blank and ``#`` lines are skipped, repeats are kept."""
    return _lines(spark, path).select(F.get("t", F.lit(0)).cast("long").alias("pmid"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(score, pmid) from lines ``pmid score ...``."""
    return _lines(spark, path).select(F.get("t", F.lit(1)).cast("double").alias("score"), F.get("t", F.lit(0)).cast("long").alias("pmid"))


def read_dated_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, date_key) from lines ``pmid YYYYMMDD``."""
    return _lines(spark, path).select(F.get("t", F.lit(0)).cast("long").alias("pmid"), F.get("t", F.lit(1)).cast("int").alias("date_key"))


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word): the distinct words of files with one a line, lower-cased."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.lower(F.trim("value")).alias("word")).distinct()


def read_stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The words as a parameter of word spaces; a list of this kind is small, and has to be."""
    found = stopwords(spark, path).limit(100_001).collect()
    if len(found) > 100_000:
        raise ValueError("more than 100000 stop words")
    return tuple(sorted(r[0] for r in found))


def drugs_from_lines(lines: DataFrame) -> DataFrame:
    """(value) tab-separated lines -> (drug_id, name, aliases); a malformed line is an error.

    Four fields; the third and fourth hold names that each end in a pipe.
    """
    parts = F.split(F.replace("value", F.lit("\r"), F.lit("")), "\t")
    rows = lines.where("replace(value, '\r', '') <> ''").select("value", parts.alias("p"))
    field = lambda i: F.get("p", F.lit(i))
    closed = lambda c: (c == "") | F.endswith(c, F.lit("|"))
    problem = F.when(F.size("p") != 4, F.lit("not four fields")).when(~(closed(field(2)) & closed(field(3))), F.lit("names must end in a pipe"))
    ok = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), F.col("value")))).otherwise(F.lit(True))
    names = lambda c: F.split(F.regexp_replace(c, r"\|\z", ""), r"\|")
    aliases = F.filter(F.concat(F.array(field(1)), names(field(2)), names(field(3))), lambda a: a != "")
    return rows.where(ok).select(field(0).alias("drug_id"), F.trim(F.get(aliases, F.lit(0))).alias("name"), aliases.alias("aliases"))


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    return drugs_from_lines(spark.read.text(path))


def _flag(text: str) -> bool:
    if text not in ("0", "1", "True", "False"):
        raise ValueError(f"not a flag: {text!r}")
    return text in ("1", "True")


_KINDS = {"limit": int, "mindate": int, "numnegs": int, "minscore": float, "submitted": float, "prevalence": float, "allfeatures": _flag, "hidden": _flag}


def parse_descriptor(lines: Iterable[str]) -> dict:
    """The ``#key = value`` header of a task file, typed by key, up to the first other line."""
    out: dict = {}
    for line in lines:
        if not line.startswith("#"):
            break
        key, _, value = line[1:].partition(" = ")
        value = value.strip()
        if key not in TASK_KEYS:
            raise KeyError(key)
        out[key] = None if value == "None" else _KINDS.get(key, str)(value)
    return out


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(file, header map, ids) of all task files under ``path``: one row a file.

    The header ends at the first other line; an unknown key is an error, the last of repeated keys counts.
    """
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.split("value", "\n").alias("lines"))
    other = F.array_position(F.transform("lines", lambda x: F.startswith(x, F.lit("#"))), False).cast("int")
    head = F.when(other > 0, F.slice("lines", 1, F.greatest(other - 1, F.lit(0)))).otherwise(F.col("lines"))
    key = lambda x: F.substring_index(F.substring(x, 2, 1 << 30), " = ", 1)
    known = lambda x: F.when(key(x).isin(list(TASK_KEYS)), key(x)).otherwise(F.raise_error(F.concat(F.lit("no such key: "), key(x))))
    pairs = F.transform(head, lambda x: F.struct(known(x).alias("key"), F.trim(F.regexp_replace(x, r"\A.*? = ", "")).alias("value")))
    # a header has few keys
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    ids = F.transform(F.filter("lines", lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#"))), lambda x: F.get(F.split(F.trim(x), r"\s+"), F.lit(0)).cast("long"))
    return text.select("file", F.map_from_entries(last).alias("header"), ids.alias("ids"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The stored article table."""
    return spark.read.schema(ARTICLE).parquet(path)


def lookup(table: DataFrame, ids: DataFrame, key: str = "pmid") -> DataFrame:
    """Rows of ``table`` with the ids, ascending; unknown ids give nothing, repeated ids one row."""
    return table.join(ids.select(key).distinct(), key, "left_semi").orderBy(key)


def missing(table: DataFrame, ids: DataFrame, key: str = "pmid") -> DataFrame:
    """The distinct ids that the table lacks."""
    return ids.select(key).distinct().join(table.select(key), key, "left_anti")


def dated_subset(rows: DataFrame, mindate: int | None = None, maxdate: int | None = None, count: int = 0, seed: int = 1) -> DataFrame:
    """(pmid, date_key) rows within the bounds, a random ``count`` of them if positive, by date."""
    from gleaner.operators.retrieve import between, random_subset

    kept = between(rows, mindate, maxdate)
    return (random_subset(kept, count, seed) if count > 0 else kept).orderBy("date_key", "pmid")


def point(table: DataFrame, value, key: str = "pmid") -> DataFrame:
    """The rows of one key; a missing key gives an empty result."""
    return table.where(F.col(key) == value)


def as_json(articles: DataFrame) -> Column:
    """An article's printable form."""
    return F.to_json(F.struct(*articles.columns))
