"""Data sources of files in formats of their own: streams of feature records, and ordered SQL statements.

Both write transactionally: every task writes a part into a hidden folder, and the commit gives the parts of the
tasks that succeeded their final names, in order, and then one manifest; readers read what a manifest lists, or, where there is
none, all files. A write that fails leaves nothing to read: its hidden folder is deleted, and a task that outlives
the failure finds no folder to write into, or leaves at most that hidden folder.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gleaner.functions import codec
from gleaner.session import small_batches

#: Id, date, and how many bytes of features follow, least byte first. (Fixed values.)
HEAD, HEAD_BYTES = "<IIH", 10
#: Bytes of a record's features at most, as its head can say; a reader may be given less.
LONGEST = (1 << 16) - 1
#: Bytes that one task reads, about, and that are in memory at once.
PART, CHUNK = 32 << 20, 4 << 20
#: Rows that a writer has as Python values at once.
SLICE = 256
#: Bytes between a part's marks, about: places where a row begins, which a manifest lists. Tasks that read a stream at most, about.
MARK, MOST_PARTS = 64 << 10, 1024
MANIFEST = "_manifest.json"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and its own path of a path or address."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def manifest(path: str) -> list[dict] | None:
    """What a folder's manifest says of its parts; None if there is none."""
    files, own = _opened(path)
    if not files.get_file_info(f"{own}/{MANIFEST}").is_file:
        return None
    with files.open_input_stream(f"{own}/{MANIFEST}") as f:
        return json.loads(f.read())


def listed(path: str, suffix: str) -> list[str]:
    """The files to read: one file, those of a folder's manifest in its order, or all with the suffix by name."""
    files, own = _opened(path)
    info = files.get_file_info(own)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    if (said := manifest(path)) is not None:
        return [f"{path}/{p['name']}" for p in said]
    return sorted(f"{path}/{i.base_name}" for i in files.get_file_info(pafs.FileSelector(own)) if i.is_file and i.base_name.endswith(suffix) and not i.base_name.startswith(("_", ".")))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Part(WriterCommitMessage):
    order: int
    path: str
    rows: int
    marks: list[int]


class PartsWriter(DataSourceArrowWriter):
    """Writes each task's rows into a part of a new hidden folder; ``pack`` makes bytes of a batch."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.staging = options["path"].rstrip("/"), overwrite, f"_staging-{uuid.uuid4().hex}"
        # made here, once, and not by tasks, which may outlive the write
        files, own = _opened(self.path)
        files.create_dir(f"{own}/{self.staging}", recursive=True)

    def pack(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        files, own = _opened(self.path)
        part = f"{own}/{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        rows, size, marks = 0, 0, [0]
        with files.open_output_stream(part) as out:
            for batch in iterator:
                for first in range(0, batch.num_rows, SLICE):
                    if size - marks[-1] >= MARK:
                        marks.append(size)
                    data = self.pack(batch.slice(first, SLICE))
                    out.write(data)
                    size += len(data)
                rows += batch.num_rows
        return Part(context.partitionId(), part, rows, [*marks, size])

    def commit(self, messages: list[Part | None]) -> None:
        files, own = _opened(self.path)
        old = [i.path for i in files.get_file_info(pafs.FileSelector(own)) if i.is_file]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        said = []
        run = self.staging.removeprefix("_staging-")[:8]
        for k, part in enumerate(sorted((m for m in messages if m and m.rows), key=lambda m: m.order)):
            name = f"part-{k:05}-{run}{self.suffix}"
            files.move(part.path, f"{own}/{name}")
            said.append({"name": name, "rows": part.rows, "marks": part.marks})
        with files.open_output_stream(f"{own}/{self.staging}/{MANIFEST}") as out:
            out.write(json.dumps(said).encode())
        # from here on the new files are the ones that are read
        files.move(f"{own}/{self.staging}/{MANIFEST}", f"{own}/{MANIFEST}")
        for p in old:
            if not p.endswith(MANIFEST):
                files.delete_file(p)
        files.delete_dir(f"{own}/{self.staging}")

    def abort(self, messages: list[Part | None]) -> None:
        files, own = _opened(self.path)
        if files.get_file_info(f"{own}/{self.staging}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{own}/{self.staging}")


# ---- feature records


class Records:
    """The records of a stream from one border to another, chunk by chunk; a bad length or a cut record is an error."""

    def __init__(self, path: str, longest: int):
        self.path, self.longest = path, longest

    def heads(self, start: int, end: int | None) -> Iterator[tuple[int, int, int, memoryview]]:
        """(place, id, date, features) of each record."""
        files, own = _opened(self.path)
        size = files.get_file_info(own).size
        end = size if end is None else end
        with files.open_input_file(own) as f:
            f.seek(start)
            held, place = b"", start
            while place < end:
                data = held + f.read(min(CHUNK, end - place - len(held)))
                at = 0
                while at + HEAD_BYTES <= len(data):
                    pmid, date, n = struct.unpack_from(HEAD, data, at)
                    if n > self.longest:
                        raise ValueError(f"{self.path}: a record of {n} bytes at {place + at}")
                    if at + HEAD_BYTES + n > len(data):
                        break
                    yield place + at, pmid, date, memoryview(data)[at + HEAD_BYTES : at + HEAD_BYTES + n]
                    at += HEAD_BYTES + n
                if not at and place + len(data) >= end:
                    raise ValueError(f"{self.path}: a record that is cut off at {place}")
                held, place = data[at:], place + at

    def borders(self, part: int) -> list[int]:
        """Places of records that are ``part`` bytes apart, about, and the end: one pass over the heads."""
        out, end = [], 0
        for place, _, _, features in self.heads(0, None):
            if not out or place - out[-1] >= part:
                out.append(place)
            end = place + HEAD_BYTES + len(features)
        return [*out, end] if out else []


def thinned(marks: list[int], part: int) -> list[int]:
    """Ascending places, of which the last is the end: the first, others ``part`` bytes apart at least, and the end."""
    out: list[int] = []
    for place in marks[:-1]:
        if not out or place - out[-1] >= part:
            out.append(place)
    return [*out, marks[-1]]


def _size(path: str) -> int:
    files, own = _opened(path)
    return files.get_file_info(own).size


class StreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.longest, self.part = options["path"].rstrip("/"), int(options.get("longest", LONGEST)), int(options.get("part", PART))

    def partitions(self) -> list[Range]:
        """Records have no marks between them: a manifest tells where some begin, and of other files the borders are found once, before the tasks read between them."""
        out, files_ = [], listed(self.path, ".stream")
        told = {f"{self.path}/{p['name']}": p["marks"] for p in manifest(self.path) or () if "marks" in p}
        part = max(self.part, sum(_size(p) for p in files_) // MOST_PARTS)
        for path in files_:
            borders = thinned(told[path], part) if path in told else Records(path, self.longest).borders(part)
            out += [Range(path, a, b) for a, b in zip(borders, borders[1:], strict=False)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = ["pmid", "date_key", "code"]
        batch = lambda: pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=names)
        if partition.path:
            for _, pmid, date, features in Records(partition.path, self.longest).heads(partition.start, partition.end):
                rows.append((pmid, date, bytes(features)))
                if len(rows) >= 8192:
                    yield batch()
                    rows = []
        yield batch()


class StreamWriter(PartsWriter):
    suffix = ".stream"

    def pack(self, batch: pa.RecordBatch) -> bytes:
        out = bytearray()
        for pmid, date, code in zip(*(batch.column(n).to_pylist() for n in ("pmid", "date_key", "code")), strict=True):
            if len(code) > LONGEST:
                raise ValueError(f"the features of {pmid} are too long: {len(code)} bytes")
            out += struct.pack(HEAD, pmid, date, len(code)) + code
        return bytes(out)


class FeatureStream(DataSource):
    """``feature_stream``: files of records (id, date, coded features) one after another, without an index."""

    @classmethod
    def name(cls) -> str:
        return "feature_stream"

    def schema(self) -> str:
        return "pmid long, date_key int, code binary"

    def reader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options, overwrite)


# ---- SQL statements


class StatementsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[Range]:
        return [Range(p, k, 0) for k, p in enumerate(listed(self.path, ".sql"))] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """(part, number, statement), in batches of bounded bytes: a statement ends with a line whose semicolon no string holds."""
        held, size, first = [], 0, 0

        def batch() -> pa.RecordBatch:
            numbers = pa.array(range(first, first + len(held)), pa.int32())
            return pa.record_batch([pa.array([partition.start] * len(held), pa.int32()), numbers, pa.array(held, pa.string())], names=["part", "number", "statement"])

        for said in statements(partition.path) if partition.path else ():
            held.append(said)
            size += len(said)
            if size >= CHUNK:
                yield batch()
                held, size, first = [], 0, first + len(held)
        yield batch()


def statements(path: str) -> Iterator[str]:
    """A file's statements."""
    files, own = _opened(path)
    with files.open_input_stream(own, compression=None) as f:
        held, rest = [], b""
        while chunk := f.read(CHUNK):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                held.append(line)
                if line.endswith(b";") and sum(x.count(b"'") for x in held) % 2 == 0:
                    yield b"\n".join(held).decode()
                    held = []


class StatementsWriter(PartsWriter):
    suffix = ".sql"

    def pack(self, batch: pa.RecordBatch) -> bytes:
        return "".join(f"{s}\n" for s in batch.column("statement").to_pylist()).encode()


class Statements(DataSource):
    """``statements``: SQL statements in files, in the order of the rows that are written."""

    @classmethod
    def name(cls) -> str:
        return "statements"

    def schema(self) -> str:
        return "part int, number int, statement string"

    def reader(self, schema: StructType) -> StatementsReader:
        return StatementsReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> StatementsWriter:
        return StatementsWriter(self.options, overwrite)


# ---- what callers use


def _register(spark: SparkSession) -> None:
    """Makes both formats known; their code goes along, so that no machine has to find this module. Writers get batches of bounded bytes."""
    small_batches(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (FeatureStream, Statements):
        spark.dataSource.register(source)


def read_feature_stream(spark: SparkSession, path: str, longest: int = LONGEST, part: int = PART) -> DataFrame:
    """(pmid, date_key, features) of a file of records, or a folder of them; a bad length is an error."""
    _register(spark)
    raw = spark.read.format("feature_stream").option("longest", longest).option("part", part).load(path)
    return raw.select("pmid", "date_key", codec.vb_decode(F.col("code")).alias("features"))


def write_feature_stream(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors as files of records; ids and dates are below 2^32, the features of one document below 64 KiB coded."""
    _register(vectors.sparkSession)
    vectors.select("pmid", "date_key", codec.vb_encode(F.col("features")).alias("code")).write.format("feature_stream").mode(mode).save(path)


def write_statements(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows with a ``statement`` as files of statements, in the order of the rows."""
    _register(rows.sparkSession)
    rows.select(F.lit(0).alias("part"), F.lit(0).alias("number"), "statement").write.format("statements").mode(mode).save(path)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, statement), which order the statements."""
    _register(spark)
    return spark.read.format("statements").load(path)
