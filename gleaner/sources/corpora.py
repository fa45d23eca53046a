"""Article and feature tables made from the documents, orders and line items of a data set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.dates import date_key
from gleaner.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line is the title, source is the journal, language a heading."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    cut = F.instr("text", "\n")
    title = F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text"))
    abstract = F.when(cut > 0, F.substring("text", cut + 1, F.length("text")))
    no_quals = F.array().cast("array<string>")
    mesh = F.array(F.struct(F.col("lang").alias("descriptor"), F.array("source", "source").alias("qualifiers")), F.struct(F.substring_index("title", " ", 1).alias("descriptor"), no_quals.alias("qualifiers")))
    people = F.array(F.struct(F.col("source").alias("initials"), F.col("lang").alias("lastname")), F.struct(F.lit(None).cast("string").alias("initials"), F.col("lang").alias("lastname")), F.struct(F.lit("X").alias("initials"), F.lit("").alias("lastname")))
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int"))
    return docs.withColumn("title", title).select(
        F.col("doc_id").alias("pmid"), "title", abstract.alias("abstract"), F.col("source").alias("journal"), F.col("source").alias("issn"), day.alias("date_completed"), F.year(day).alias("pubyear"), mesh.alias("meshterms"), people.alias("authors")
    )


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, label): labelled documents, 1 is relevant."""
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pmid"), F.col("toxic").alias("label"))


def basket_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, date_key): orders as articles."""
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pmid"), date_key(F.col("o_orderdate")).alias("date_key"))


def basket_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 10 == 0)).select(F.col("o_orderkey").alias("pmid"))


def basket_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, ftype, fname), distinct: what the parts of an order are."""
    sets = basket_sets(spark, sf_dir)
    return sets.select("pmid", F.explode("names").alias("f")).select("pmid", "f.ftype", "f.fname")


#: The kinds of a line item's names, and their columns.
KINDS = {"brand": "p_brand", "type": "p_type", "size": "p_size", "flag": "l_returnflag"}
#: Names of a kind that are coded at most: four codes fit in a long.
BITS = 16
MOST_CODES = (1 << BITS) - 1


def basket_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, names): the features of an order as one array of (ftype, fname).

    One shuffle of line items by order, as plain rows; the sets come out of it already distinct. A line item's names are one
    long where each kind has few enough, else strings, which take several times the memory.
    """
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    known = {}
    for c in KINDS.values():
        known[c] = _few(lines if c in lines.columns else parts, c)
        if known[c] is None:
            return _sets_of_strings(lines, parts)
    for c, values in known.items():
        if c in lines.columns:
            lines = _coded(lines, c, values)
        else:
            parts = _coded(parts, c, values)
    own = [c for c in KINDS.values() if c in parts.columns]
    parts = parts.select("p_partkey", _packed(own).alias("look"))
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("pmid"), F.col("look").bitwiseOR(_packed(["l_returnflag"])).alias("code"))
    sets = _sets(rows, {"codes": "code"})
    # one row of bounded lists, with null for code 0
    told = spark.createDataFrame([tuple([None, *known[c]] for c in KINDS.values())], ", ".join(f"_{k} array<string>" for k in KINDS))
    pairs = F.concat(*(F.transform(_unpacked("codes", c), _named(kind, f"_{kind}")) for kind, c in KINDS.items()))
    return sets.crossJoin(F.broadcast(told)).select("pmid", pairs.alias("names"))


def _few(rows: DataFrame, column: str) -> list[str] | None:
    """A column's distinct values; None if they are too many for a code."""
    got = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_CODES + 1).collect()]
    return sorted(got) if len(got) <= MOST_CODES else None


def _coded(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """``column`` as its value's place, from 1; 0 for null."""
    places = rows.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values, 1)], "_value string, _place long")
    return rows.join(F.broadcast(places), F.col(column) == F.col("_value"), "left").withColumn(column, F.coalesce("_place", F.lit(0).cast("long"))).drop("_value", "_place")


def _at(column: str) -> int:
    return BITS * list(KINDS.values()).index(column)


def _packed(columns: Sequence[str]) -> Column:
    """Codes in one long, each at its own bits."""
    return reduce(Column.bitwiseOR, (F.shiftleft(c, _at(c)) for c in columns))


def _unpacked(codes: str, column: str) -> Column:
    """The distinct codes of a column, without 0."""
    return F.array_remove(F.array_distinct(F.transform(codes, lambda x: F.shiftrightunsigned(x, _at(column)).bitwiseAND(F.lit(MOST_CODES)).cast("int"))), 0)


def _sets_of_strings(lines: DataFrame, parts: DataFrame) -> DataFrame:
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("pmid"), *KINDS.values())
    return _sets(rows, KINDS).select("pmid", F.concat(*(F.transform(k, _named(k)) for k in KINDS)).alias("names"))


def _sets(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """(pmid, columns): the distinct values of each order that are not null.

    A window over the order: an aggregate of sets sorts rows twice, with what it has collected, and spills.
    """
    order = Window.partitionBy("pmid").orderBy(*columns.values())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.repartition("pmid").select("pmid", F.row_number().over(order).alias("_n"), *(F.collect_set(c).over(whole).alias(k) for k, c in columns.items()))
    return told.where("_n = 1").drop("_n")


def _named(ftype: str, values: str | None = None):
    return lambda x: F.struct(F.lit(ftype).alias("ftype"), (x if values is None else F.get(values, x)).alias("fname"))
