"""Lookups of the elements of documents' arrays in tables that are too large to be sent to every task.

Documents are taken in blocks. A block's distinct elements, each once, are joined with the table, and what is found comes
back to the block, whose documents hold places in its list. So the join has a row per block and element, not one per
document and element; a task holds a block's places.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.dense import flat, heard, lists, said
from gleaner.session import Cuts, small_batches

#: Elements of a block, more only if one batch of documents has more (32 MB of places).
BLOCK = 1 << 23
#: Rows of a batch of distinct elements.
ROWS = 1 << 16


def coded(docs: DataFrame, column: str, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """(block, other columns, codes) per document, and (of, code, value, n) per distinct element of a block, which is there n times; null elements have null codes.

    Both are written at once: a block's number is that of its task and its place in it.
    """
    small_batches(docs.sparkSession)
    others = [f for f in docs.schema.fields if f.name != column]
    value = docs.schema[column].dataType.elementType
    width = len(others)

    def run(batches):
        first, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            number = first + made
            spelt = pa.chunked_array([e for _, _, e in held]).unify_dictionaries().chunks
            for (rest, lengths, _), codes in zip(held, spelt, strict=True):
                offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
                n = len(lengths)
                yield _batch([pa.array(np.full(n, number)), *rest, pa.ListArray.from_arrays(offsets, codes.indices.cast(pa.int32())), None, None, None], n)
            values = spelt[0].dictionary
            counts = sum(np.bincount(c.indices.drop_null().to_numpy(), minlength=len(values)) for c in spelt)
            for at in range(0, len(values), ROWS):
                some = values.slice(at, ROWS)
                n = len(some)
                yield _batch([pa.array(np.full(n, number)), *([None] * width), None, pa.array(np.arange(at, at + n, dtype=np.int32)), some, pa.array(counts[at : at + n])], n)

        def _batch(columns, n):
            return pa.record_batch([pa.nulls(n, f.type) if c is None else c.cast(f.type) for c, f in zip(columns, shape_arrow, strict=True)], schema=shape_arrow)

        shape_arrow = None
        for batch in batches:
            if shape_arrow is None:
                kinds = [f.type for f in batch.schema]
                shape_arrow = pa.schema([("block", pa.int64()), *((f.name, kinds[k]) for k, f in enumerate(others)), ("codes", pa.list_(pa.int32())), ("code", pa.int32()), ("value", kinds[-1].value_type), ("n", pa.int64())])
            row, elements = flat(batch.column(width))
            if held and size + len(elements) > BLOCK:
                yield from block()
                made, held, size = made + 1, [], 0
            held.append(([batch.column(k) for k in range(width)], np.bincount(row, minlength=batch.num_rows), elements.dictionary_encode()))
            size += len(elements)
        if held:
            yield from block()

    free = [T.StructField(f.name, f.dataType) for f in others]
    shape = T.StructType([T.StructField("block", T.LongType()), *free, T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("code", T.IntegerType()), T.StructField("value", value), T.StructField("n", T.LongType())])
    both = cuts.write(docs.select(*(f.name for f in others), column).mapInArrow(run, shape))
    return both.where("code is null").select("block", *(f.name for f in others), "codes"), both.where("code is not null").select(F.col("block").alias("of"), "code", "value", "n")


def _met(docs: DataFrame, found: DataFrame, ready: Callable[[pa.Table], Callable[[pa.RecordBatch], pa.RecordBatch]], shape: T.StructType) -> DataFrame:
    """Each batch of a block's documents through what ``ready`` makes of all that the block's elements have found."""

    def block(own: pa.Table, got: pa.Table) -> pa.Table:
        run = ready(got)
        return pa.Table.from_batches([run(b) for b in own.to_batches()])

    return docs.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(block, shape)


def _by_code(got: pa.Table, column: str, missing: float) -> np.ndarray:
    """A table's column by code; ``missing`` where a code has found nothing, and at the last place."""
    codes = got.column("code").to_numpy()
    out = np.full(codes.max(initial=-1) + 2, missing)
    out[codes] = got.column(column).to_numpy()
    return out


def _places(codes: pa.Array, known: np.ndarray) -> np.ndarray:
    """Codes as places in ``known``, the last one for null and missing ones."""
    at = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
    return np.where((at < 0) | (at >= len(known)), len(known) - 1, at)


def coded_names(sets: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """``coded`` of (pmid, date_key, names array of (ftype, fname))."""
    names = F.transform("names", lambda x: said(x["ftype"], x["fname"]))
    return coded(sets.select("pmid", "date_key", names.alias("names")), "names", cuts)


def document_frequency(terms: DataFrame) -> DataFrame:
    """(ftype, fname, df) of coded names that are distinct per document."""
    return terms.groupBy("value").agg(F.sum("n").alias("df")).select(*heard("value"), "df")


def numbered(sets: DataFrame, vocab: DataFrame) -> DataFrame:
    """(pmid, date_key, names array of (ftype, fname)) -> (pmid, date_key, features): sorted ids, each once; unknown names are dropped, null is empty."""
    return numbered_codes(*coded_names(sets, Cuts(sets.sparkSession, "blocks")), vocab)


def numbered_codes(docs: DataFrame, terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """``numbered`` of coded names."""
    known = vocab.select(said(F.col("ftype"), F.col("fname")).alias("value"), F.col("fid").cast("int").alias("fid"))
    found = terms.join(known, "value").select("of", "code", "fid")

    def ready(got):
        fids = _by_code(got, "fid", -1)

        def run(own):
            row, codes = flat(own.column("codes"))
            ids = fids[_places(codes, fids)]
            return pa.record_batch([own.column("pmid"), own.column("date_key"), lists(row[ids >= 0], ids[ids >= 0], own.num_rows)], names=["pmid", "date_key", "features"])

        return run

    return _met(docs, found, ready, T.StructType([docs.schema["pmid"], docs.schema["date_key"], T.StructField("features", T.ArrayType(T.IntegerType()))]))


def summed(docs: DataFrame, weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """(pmid, names): for each column of ``weights`` (fid, names) the sum over the document's distinct features; unknown ones weigh nothing."""
    features = F.array_distinct(F.col("features").cast("array<long>"))
    own, terms = coded(docs.select("pmid", features.alias("features")), "features", Cuts(docs.sparkSession, "blocks"))
    told = weights.select(F.col("fid").cast("long").alias("value"), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names))
    found = terms.join(told, "value").drop("value", "n")

    def ready(got):
        known = [_by_code(got, n, 0.0) for n in names]

        def run(own):
            row, codes = flat(own.column("codes"))
            at = _places(codes, known[0])
            return pa.record_batch([own.column("pmid"), *(pa.array(np.bincount(row, w[at], own.num_rows).astype(np.float64)) for w in known)], names=["pmid", *names])

        return run

    return _met(own, found, ready, T.StructType([docs.schema["pmid"], *(T.StructField(n, T.DoubleType()) for n in names)]))
