"""Incremental ingestion as a file stream, with a ledger of base names.

A file is known by its base name, whatever directory it comes from: the stream's checkpoint knows paths, and the
store's ledger names. A batch adds its articles, then each feature space's deltas, then its files to the ledger,
and is committed at the end: until then nothing of it is seen, and when it runs again it is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.dates import date_key
from gleaner.operators.features import extract
from gleaner.session import Cuts
from gleaner.sources.readers import ARTICLE, ARTICLE_COLUMNS, CITATION, citation_articles
from gleaner.streaming.growing import Batches, GrowingIndex

FILES = "name string, path string"
#: Batches from which a run ends with a merge of all.
MANY = 64


class Store:
    """Tables below a root: articles, the ledger of files, and a growing index per feature space."""

    def __init__(self, spark: SparkSession, root: str, spaces: tuple[str, ...] = ("mqi",)):
        self.spark, self.batches, self.spaces = spark, Batches(spark, root), spaces
        self.indexes = {s: GrowingIndex(self.batches, f"spaces/{s}") for s in spaces}

    def articles(self) -> DataFrame:
        return self.batches.read("articles", ARTICLE)

    def files(self) -> DataFrame:
        """(name, path): the files that are in, by base name."""
        return self.batches.read("files", FILES)

    def frequencies(self, space: str) -> DataFrame:
        """(ftype, fname, df) over all batches."""
        return self.indexes[space].vocabulary().select("ftype", "fname", "df")

    def index(self, space: str) -> tuple[DataFrame, DataFrame]:
        """(vectors, vocabulary) of all articles."""
        return self.indexes[space].vectors(), self.indexes[space].vocabulary()

    def add(self, rows: DataFrame, batch: int) -> None:
        """A batch of articles, with their ``file`` if they come from files.

        Files whose base name is in the ledger bring nothing, nor does the second of a name in a batch. Of articles with one
        id the first counts, by the names of their files; those that an earlier batch has are not added again.
        """
        if self.batches.committed(batch):
            return
        if "file" not in rows.columns:
            rows = rows.withColumn("file", F.lit(""))
        cuts = Cuts(self.spark, "ingest")
        rows = cuts.write(rows.withColumn("name", F.element_at(F.split("file", "/"), -1)))
        unseen = rows.where("file <> ''").join(self.files().select("name"), "name", "left_anti")
        files = self.batches.write("files", unseen.groupBy("name").agg(F.min("file").alias("path")), batch, FILES)
        taken = rows.join(files.select("name", F.col("path").alias("file")), ["name", "file"], "left_semi").unionByName(rows.where("file = ''"))
        first = taken.groupBy("pmid").agg(F.min_by(F.struct(*(c for c in ARTICLE_COLUMNS if c != "pmid")), "name").alias("a")).select("pmid", "a.*")
        fresh = self.batches.write("articles", first.join(self.articles().select("pmid"), "pmid", "left_anti").select(*ARTICLE_COLUMNS), batch, ARTICLE)
        dated = fresh.select("pmid", date_key(F.col("date_completed")).alias("date_key"))
        for space, own in self.indexes.items():
            own.add(dated, extract(fresh, space), batch)
        self.batches.commit(batch)
        cuts.drop(rows)

    def compact(self) -> None:
        """Merges all batches; ids and results stay."""
        tables = {"articles": (ARTICLE, lambda t: t), "files": (FILES, lambda t: t)}
        for own in self.indexes.values():
            tables |= own.tables()
        self.batches.merge(tables)

    def regenerate(self, space: str) -> list[str]:
        """Makes a space's lost tables from the articles and what is left; returns their names."""
        articles = self.articles()
        return self.indexes[space].regenerate(articles.select("pmid", date_key(F.col("date_completed")).alias("date_key")), extract(articles, space))


def stream_citations(spark: SparkSession, directory: str) -> DataFrame:
    raw = spark.readStream.format("xml").option("rowTag", "MedlineCitation").option("pathGlobFilter", "{*.xml,*.xml.gz}").schema(CITATION).load(directory)
    return citation_articles(raw.withColumn("file", F.col("_metadata.file_path")))


def ingest(store: Store, directory: str, checkpoint: str) -> StreamingQuery:
    """Adds every file that the checkpoint has not seen, in one batch, and ends.

    The checkpoint's batches are numbered from 0, so a store has one checkpoint; of several
    directories, name their common one or a pattern.
    """
    rows = stream_citations(store.spark, directory)
    query = rows.writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if len(store.batches.folders()) > MANY:
        store.compact()
    return query


def running_counts(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Counts of a stream's keys so far, for complete or update output."""
    return events.groupBy(key).agg(F.count("*").alias("n"))
