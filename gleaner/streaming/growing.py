"""An index that grows by batches: ids of features never change, and a batch touches its own rows only.

Every batch is a set of deltas: the names that it is the first to have, with the next free ids; by how
much each feature's count grows; and its documents' vectors. Counts are added up when
they are read. Of what is there already a batch reads the names, to find its own among them, and the ids of documents.

Deltas are seen once their batch is committed, which is one file made at the end; a batch
that failed is written anew under its number. Compaction merges all deltas into one, with the same ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import index
from gleaner.session import Cuts, children, delete, exists, make_file


class Batches:
    """Tables below a root, a folder for each batch; a merged set of batches up to n is the folder -(n + 1)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self) -> tuple[int, list[int]]:
        """The last merged batch, or -1, and the committed ones after it."""
        found = children(self.spark, f"{self.root}/commits")
        merged = max((int(f.removeprefix("upto-")) for f in found if f.startswith("upto-")), default=-1)
        return merged, sorted(int(f) for f in found if f.isdigit() and int(f) > merged)

    def committed(self, batch: int) -> bool:
        merged, single = self._commits()
        return batch <= merged or batch in single

    def last(self) -> int:
        """The last committed batch, -1 if there is none."""
        merged, single = self._commits()
        return max([merged, *single])

    def folders(self) -> list[int]:
        """The folders that hold what is committed, in the order of batches."""
        merged, single = self._commits()
        return [*([-merged - 1] if merged >= 0 else []), *single]

    def path(self, name: str, folder: int) -> str:
        return f"{self.root}/{name}/batch={folder}"

    def read(self, name: str, schema: str, folders: list[int] | None = None) -> DataFrame:
        """A table of all committed batches, or of some folders."""
        paths = [p for f in (self.folders() if folders is None else folders) if exists(self.spark, p := self.path(name, f))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, batch: int, schema: str) -> DataFrame:
        """Writes a batch's part of a table, and reads it."""
        rows.write.mode("overwrite").parquet(self.path(name, batch))
        return self.read(name, schema, [batch])

    def commit(self, batch: int) -> None:
        make_file(self.spark, f"{self.root}/commits/{batch}")

    def merge(self, tables: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]) -> None:
        """Writes each table of all committed batches as one, as its function makes it, and lets go of what was merged before.

        The folders that are merged now stay until the next merge, for plans that still read them.
        """
        merged, single = self._commits()
        if not single:
            return
        for name, (schema, made) in tables.items():
            made(self.read(name, schema)).write.mode("overwrite").parquet(self.path(name, -single[-1] - 1))
        old = [f for name in tables for f in children(self.spark, f"{self.root}/{name}") if f.startswith("batch=") and -merged - 1 < int(f[6:]) <= merged]
        make_file(self.spark, f"{self.root}/commits/upto-{single[-1]}")
        for name in tables:
            for f in set(old):
                delete(self.spark, f"{self.root}/{name}/{f}")


NAMES, COUNTS, VECTORS = "fid int, ftype string, fname string", "fid int, df long", "pmid long, date_key int, features array<int>"


class GrowingIndex:
    """Names, counts and vectors of one feature space, below a prefix."""

    def __init__(self, batches: Batches, prefix: str = "index"):
        self.batches, self.prefix = batches, prefix

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.batches.read(f"{self.prefix}/{name}", schema)

    def names(self) -> DataFrame:
        return self._read("names", NAMES)

    def vectors(self) -> DataFrame:
        """(pmid, date_key, features) of all documents."""
        return self._read("vectors", VECTORS)

    def vocabulary(self) -> DataFrame:
        """(fid, ftype, fname, df): a feature's id is the same after every batch."""
        counts = self._read("counts", COUNTS).groupBy("fid").agg(F.sum("df").alias("df"))
        return self.names().join(counts, "fid").select("fid", "ftype", "fname", "df")

    def add(self, articles: DataFrame, long: DataFrame, batch: int) -> None:
        """Adds articles (pmid, date_key) that are not indexed yet, with their features (pmid, ftype, fname); the caller commits.

        New names get the next ids in the order of type and name.
        """
        cuts = Cuts(self.batches.spark, "batch")
        fresh = cuts.write(articles.select("pmid", "date_key").join(self.vectors().select("pmid"), "pmid", "left_anti"))
        own = cuts.write(long.join(fresh.select("pmid"), "pmid", "left_semi"))
        delta = cuts.write(index.document_frequency(own))
        names = self.names()
        known = delta.join(names, ["ftype", "fname"])
        top = names.agg(F.coalesce(F.max("fid"), F.lit(0)).alias("top")).first().top
        new = index.numbered(delta.join(names, ["ftype", "fname"], "left_anti"), top + 1, cuts)
        all_ = cuts.write(known.select("fid", "ftype", "fname", "df", F.lit(False).alias("new")).unionByName(new.select("fid", "ftype", "fname", "df", F.lit(True).alias("new"))))
        put = lambda name, rows, schema: self.batches.write(f"{self.prefix}/{name}", rows, batch, schema)
        put("names", all_.where("new").select("fid", "ftype", "fname"), NAMES)
        put("counts", all_.select("fid", "df"), COUNTS)
        put("vectors", index.vectors(fresh, own, all_), VECTORS)
        for t in (fresh, own, delta, all_):
            cuts.drop(t)

    def tables(self) -> dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]:
        """What ``Batches.merge`` merges, and how."""
        return {
            f"{self.prefix}/names": (NAMES, lambda t: t), f"{self.prefix}/vectors": (VECTORS, lambda t: t),
            f"{self.prefix}/counts": (COUNTS, lambda t: t.groupBy("fid").agg(F.sum("df").alias("df"))),
        }

    def regenerate(self, articles: DataFrame, long: DataFrame) -> list[str]:
        """Writes the committed tables that are gone, from the others; returns their names.

        Vectors come from the names and all articles' features, counts from the vectors, both as one merged delta with the
        ids as they were. Names cannot come from what is left: without them all must be gone, and everything is added anew.
        """
        gone = [n for n in ("names", "counts", "vectors") if self.batches.folders() and not any(exists(self.batches.spark, self.batches.path(f"{self.prefix}/{n}", f)) for f in self.batches.folders())]
        first = next(iter(self.batches.folders()), 0)
        if "names" in gone:
            if len(gone) < 3:
                raise ValueError("names are gone, but not counts and vectors: they cannot be made to fit")
            self.add(articles, long, first)
            return gone
        put = lambda name, rows, schema: self.batches.write(f"{self.prefix}/{name}", rows, first, schema)
        if "vectors" in gone:
            put("vectors", index.vectors(articles, long, self.names()), VECTORS)
        if "counts" in gone:
            put("counts", self.vectors().select(F.explode("features").alias("fid")).groupBy("fid").agg(F.count("*").alias("df")), COUNTS)
        return gone
