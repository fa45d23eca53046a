"""Sums of weights over documents' features, and names to ids, document by document: where the weights or names are few enough to be sent to every task.

Nothing is exploded, shuffled or grouped then, so a task's memory is that of a batch. Callers join where ``table`` or ``names`` gives None.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import reach

#: Weights (128 MB a worker) or names that are sent at most; larger models and vocabularies are met by blocks. Weights pass the driver in slices (8 MB).
MOST = 1 << 24
SLICE = 1 << 20
MOST_NAMES = 1 << 18


def table(weights: DataFrame, columns: Sequence[str]) -> list[Broadcast] | None:
    """(fid, columns) with a row per id -> arrays of consecutive ids from 0, with a row for each, zero where there is none; None if they are too large."""
    rows = weights.where("fid is not null").select("fid", *columns)
    low, top = rows.agg(F.min("fid"), F.max("fid")).first()
    top = -1 if top is None else top
    if top >= 0 and (low < 0 or (top + 1) * len(columns) > MOST):
        return None
    step, sent = max(1, SLICE // len(columns)), []
    for first in range(0, max(1, top + 1), step):
        out = np.zeros((max(1, min(step, top + 1 - first)), len(columns)))
        got = rows.where((F.col("fid") >= first) & (F.col("fid") < first + step)).toArrow()
        ids = got.column("fid").to_numpy() - first
        for k, c in enumerate(columns):
            out[ids, k] = got.column(c).fill_null(0.0).to_numpy()
        sent.append(weights.sparkSession.sparkContext.broadcast(out))
    return sent


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of lists: the row of each element, and the elements."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def lists(row: np.ndarray, ids: np.ndarray, rows: int) -> pa.ListArray:
    """Each row's ids, sorted and each once."""
    order = np.lexsort((ids, row))
    row, ids = row[order], ids[order]
    first = np.append(np.ones(len(row[:1]), bool), (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))
    row, ids = row[first], ids[first]
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=rows)))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def summed(docs: DataFrame, weights: Sequence[Broadcast], names: Sequence[str]) -> DataFrame:
    """(pmid, names): for each column of a ``table`` the sum over the document's distinct features; unknown ones weigh nothing."""
    reach(docs.sparkSession)
    sent = list(weights)

    def run(batches):
        slices = [b.value for b in sent]
        for batch in batches:
            row, ids = flat(batch.column(1))
            ids = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False)
            if ((row[1:] == row[:-1]) & (ids[1:] <= ids[:-1])).any():
                pairs = np.unique(np.stack([row, ids], 1), axis=0)
                row, ids = pairs[:, 0], pairs[:, 1]
            found, first = np.zeros((len(ids), len(names))), 0
            for known in slices:
                here = (ids >= first) & (ids < first + len(known))
                found[here] = known[ids[here] - first]
                first += len(known)
            sums = [pa.array(np.bincount(row, found[:, k], batch.num_rows).astype(np.float64)) for k in range(len(names))]
            yield pa.record_batch([batch.column(0), *sums], names=["pmid", *names])

    shape = T.StructType([docs.schema["pmid"], *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.select("pmid", F.col("features").cast("array<long>").alias("features")).mapInArrow(run, shape)


def names(vocab: DataFrame) -> pa.Table | None:
    """(fid, name) of a vocabulary, ``name`` being type and name; None if they are too many."""
    if vocab.count() > MOST_NAMES:
        return None
    return vocab.where("ftype is not null and fname is not null").select(F.col("fid").cast("int").alias("fid"), said(F.col("ftype"), F.col("fname")).alias("name")).toArrow()


def said(ftype: Column, fname: Column) -> Column:
    # the length tells where the type ends, whatever characters it has
    return F.concat(F.length(ftype).cast("string"), F.lit(":"), ftype, fname)


def heard(name: str) -> tuple[Column, Column]:
    """Type and name of what ``said`` has made."""
    long, rest = F.substring_index(name, ":", 1).cast("int"), F.instr(name, ":") + 1
    return F.substring(name, rest, long).alias("ftype"), F.substring(name, rest + long, F.length(name)).alias("fname")


def numbered(sets: DataFrame, known: pa.Table) -> DataFrame:
    """(pmid, date_key, names array of (ftype, fname)) -> (pmid, date_key, features): sorted ids, each once; unknown names are dropped, null is empty."""
    reach(sets.sparkSession)
    fids, value_set = known.column("fid").to_numpy(), known.column("name").combine_chunks()
    sent = sets.sparkSession.sparkContext.broadcast((fids, value_set))

    def run(batches):
        fids, value_set = sent.value
        for batch in batches:
            row, spelt = flat(batch.column(2))
            at = pc.fill_null(pc.index_in(spelt, value_set=value_set), -1).to_numpy(zero_copy_only=False)
            ok = at >= 0
            row, ids = row[ok], fids[at[ok]].astype(np.int64) if ok.any() else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), lists(row, ids, batch.num_rows)], names=["pmid", "date_key", "features"])

    given = F.transform("names", lambda x: said(x["ftype"], x["fname"]))
    shape = T.StructType([sets.schema["pmid"], sets.schema["date_key"], T.StructField("features", T.ArrayType(T.IntegerType()))])
    return sets.select("pmid", "date_key", given.alias("names")).mapInArrow(run, shape)
