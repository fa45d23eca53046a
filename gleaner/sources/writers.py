"""Sinks: score and id files, tables as CSV, task files, SQL exports, and the tables of a report."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import TASK_KEYS, Params
from gleaner.operators import metrics
from gleaner.operators.browse import paged, rendered
from gleaner.operators.model import Model, feature_stats, feature_table, top_tfidf
from gleaner.operators.retrieve import ranked
from gleaner.session import Cuts
from gleaner.sources.files import listed, statements, write_statements


def score_lines(scores: DataFrame, ordered: bool = True) -> DataFrame:
    """(value): the id, ten wide and left-justified, a space and the score; best first if ``ordered``."""
    rows = scores.orderBy(F.desc("score"), F.desc("pmid")) if ordered else scores
    return rows.select(F.format_string("%-10d %f", "pmid", "score").alias("value"))


def id_lines(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("pmid").cast("string").alias("value"))


def dated_lines(docs: DataFrame) -> DataFrame:
    """(value): id and eight-digit date, by date."""
    return docs.orderBy("date_key", "pmid").select(F.format_string("%d %08d", "pmid", "date_key").alias("value"))


def lines(rows: DataFrame, separator: str = "\t") -> DataFrame:
    """(value): all columns as text with a separator; nulls are empty."""
    return rows.select(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)).alias("value"))


def rank_lines(curve: DataFrame) -> DataFrame:
    """(value): rank, true positives, recall and precision."""
    return curve.orderBy("rank").select(F.format_string("%d, %d, %.6f, %.6f", "rank", "tp", "recall", "precision").alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, separator: str = ",", mode: str = "overwrite", header: bool = True) -> None:
    rows.write.mode(mode).option("header", header).option("sep", separator).csv(path)


def write_feature_csv(model: Model, path: str, most: int | None = None) -> None:
    write_csv(feature_table(model, most), path)


def write_pages(results: DataFrame, path: str, perfile: int) -> None:
    """One directory per page of rendered citations."""
    paged(rendered(results), perfile).write.mode("overwrite").partitionBy("page").parquet(path)


def experiment_row(name: str, labelled: DataFrame, model: Model, params: Params = Params()) -> DataFrame:
    """One row: averaged precision, ROC area, aggressivity, break-even and eleven precisions."""
    ratios = metrics.ratio_curve(metrics.confusion_curve(labelled), params.alpha, params.utility)
    eleven = metrics.precision_11(ratios).agg(*(F.max(F.when(F.round(F.col("recall") * 10) == k, F.col("precision"))).alias(f"p{k}") for k in range(11)))
    row = metrics.averaged_precision(labelled).crossJoin(metrics.roc_error(metrics.confusion_curve(labelled)).select("w"))
    row = row.crossJoin(feature_stats(model, params.type_mask).select("aggressivity")).crossJoin(metrics.breakeven(ratios).select("breakeven")).crossJoin(eleven)
    return row.withColumn("name", F.lit(name)).select("name", "avprec", "w", "aggressivity", "breakeven", *(f"p{k}" for k in range(11)))


def descriptor_lines(values: Mapping, ids: Iterable[int] = ()) -> list[str]:
    """A task file's lines; only known keys are written."""
    return [f"#{k} = {v}" for k, v in values.items() if k in TASK_KEYS] + [str(i) for i in ids]


def query_report(results: DataFrame, inputs: DataFrame, model: Model, articles: DataFrame, params: Params, maxreport: int = 1000, perfile: int = 100) -> dict[str, DataFrame]:
    """The tables of a retrieval report: parameters, feature statistics, best terms, inputs and paged results."""
    spark = results.sparkSession
    shown = paged(rendered(results.where(F.col("rank") <= maxreport).join(articles, "pmid")), perfile)
    given = spark.createDataFrame([(k, str(v)) for k, v in vars(params).items()], "name string, value string")
    return {
        "parameters": given, "stats": feature_stats(model, params.type_mask), "top_terms": top_tfidf(model),
        "features": feature_table(model), "inputs": rendered(ranked(inputs, maxreport).join(articles, "pmid")), "results": shown,
    }


def validation_report(labelled: DataFrame, model: Model, params: Params = Params(), threshold: float | None = 0.0) -> dict[str, DataFrame]:
    """The tables of a validation report: metrics, ranges over folds, curves and histograms."""
    ratios = metrics.ratio_curve(metrics.confusion_curve(labelled), params.alpha, params.utility)
    point = metrics.operating_point(labelled, threshold, params.alpha, params.utility).first()
    return {
        "summary": metrics.summary(labelled, threshold, params.alpha, params.utility), "ranges": metrics.performance_range(labelled, point.score, params.alpha, params.utility),
        "curve": metrics.interpolated(ratios, "fpr", "tpr"), "ratios": ratios, "precision_11": metrics.precision_11(ratios),
        "score_histogram": metrics.histogram(labelled, by=("label",)), "feature_histogram": metrics.feature_histogram(model.weights), "features": feature_table(model), "stats": feature_stats(model, params.type_mask),
    }


def write_report(tables: Mapping[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def export_jdbc(tables: Mapping[str, DataFrame], url: str, properties: Mapping[str, str] | None = None, mode: str = "append") -> None:
    """The star schema to a database that the session has a driver for."""
    for name, df in tables.items():
        df.write.jdbc(url, name, mode, dict(properties or {}))


#: Tables of the export, in the order in which they refer to each other. (Fixed values.)
SCHEMA = (
    "CREATE TABLE cbs (pmid VARCHAR(8) PRIMARY KEY, title VARCHAR(1024), abs VARCHAR(2500), genes VARCHAR(1024), drugs VARCHAR(1024), coes VARCHAR(1024), evid_loc VARCHAR(1024));",
    "CREATE TABLE genedrug (id INTEGER PRIMARY KEY, gene VARCHAR(255), drug VARCHAR(255), numarticles INTEGER);",
    "CREATE TABLE dg_pmids (pmid VARCHAR(8), text VARCHAR(2500), dg_id INTEGER REFERENCES genedrug(id));",
)


#: The order of each table's rows.
_KEYS = {"cbs": ["pmid"], "genedrug": ["id"], "dg_pmids": ["dg_id", "pmid"]}


def export_sql(tables: Mapping[str, DataFrame], path: str) -> list[str]:
    """Files of statements: the schema, then each table's inserts in its own folder, in the order of its key. Returns the folders in order.

    A table's files are there once all of them are written; rows are dealt by range, so the parts follow each other.
    """
    from gleaner.operators.cooccur import insert_statements

    spark = next(iter(tables.values())).sparkSession
    folders = [f"{path}/0_schema"]
    write_statements(spark.createDataFrame([(s,) for s in SCHEMA], "statement string").coalesce(1), folders[0])
    for k, name in enumerate(("genedrug", "dg_pmids", "cbs"), 1):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = tables[name].repartitionByRange(parts, *_KEYS[name]).sortWithinPartitions(*_KEYS[name])
        folders.append(f"{path}/{k}_{name}")
        write_statements(insert_statements(rows, name).withColumnRenamed("value", "statement"), folders[-1])
    return folders


def export_sqlite(tables: Mapping[str, DataFrame], path: str) -> None:
    """The export's files of statements, run into one new local SQLite file in one transaction."""
    import sqlite3

    if os.path.exists(path):
        os.remove(path)
    cuts = Cuts(next(iter(tables.values())).sparkSession, "export")
    with sqlite3.connect(path) as con:
        for folder in export_sql(tables, f"{cuts.root}/sql"):
            for part in listed(folder, ".sql"):
                for said in statements(part):
                    con.execute(said)


def zip_directory(directory: str, target: str, skip: Iterable[str] = ()) -> None:
    """A local directory's files, without zips and those named in ``skip``."""
    root, left_out = Path(directory), set(skip)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix != ".zip" and p.name not in left_out:
                z.write(p, p.relative_to(root))
