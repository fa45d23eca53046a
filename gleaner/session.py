"""Sessions: settings for a local run, written intermediates, stored tables, and making this package known to Python workers."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleaner")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, where the files have less than half as many splits: for work that is dear per row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def reach(spark: SparkSession) -> None:
    """Let workers on machines that hold this package at the same place import it."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


#: Arrow batches of whole texts: few rows each, so a worker holds few long texts at once.
TEXT_BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Ready Python workers: they can import this package, and get Arrow batches of bounded bytes."""
    reach(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < byte_count(str(spark.conf.get(key))) <= TEXT_BATCH_BYTES:
        spark.conf.set(key, str(TEXT_BATCH_BYTES))


def byte_count(said: str) -> int:
    """Bytes of a Spark size such as ``64m`` or ``4194304b``; 0 if it is none."""
    found = re.fullmatch(r"(\d+)([kmgtp]?)b?", said.strip().lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder; a cluster
    must name one, because executors do not share the driver's temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="gleaner-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def make_file(spark: SparkSession, path: str) -> None:
    """An empty file, which is there at once or not at all."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


_left: list[tuple[SparkSession, str]] = []


@atexit.register
def _end() -> None:
    """Deletes what cuts have left. Results may read them until the program ends."""
    for spark, root in _left:
        with contextlib.suppress(Exception):  # the JVM may be gone
            delete(spark, root)


class Cuts:
    """Tables written in the shared folder, so that lost executors cost no recomputation.

    ``write`` cuts a plan's lineage; ``drop`` deletes tables that no later plan reads, and
    the rest goes when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        _left.append((spark, self.root))

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.cut_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df.cut_path)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the files below some paths: their names, sizes and times. Spark lists them; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    h = [F.sum(F.xxhash64(F.lit(k), "path", "length", "modificationTime").cast("decimal(38,0)")) for k in (1, 2)]
    return hashlib.sha256("|".join(str(x) for x in files.agg(F.count("*"), *h).first()).encode()).hexdigest()[:24]


def stored(spark: SparkSession, name: str, paths: Sequence[str], make: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables made from the files below ``paths``, kept in the shared folder and made anew if the files change.

    They are complete where their folder has its final name; two makers at once do no harm.
    """
    root = f"{shared_dir(spark)}/stored/{name}-{fingerprint(spark, paths)}"
    if not exists(spark, root):
        own = f"{root}-{uuid.uuid4().hex}"
        for k, df in make().items():
            df.write.parquet(f"{own}/{k}")
        p = spark._jvm.org.apache.hadoop.fs.Path
        fs = p(own).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p(root)) or not fs.rename(p(own), p(root)):
            delete(spark, own)
    return {name: spark.read.parquet(f"{root}/{name}") for name in children(spark, root)}
