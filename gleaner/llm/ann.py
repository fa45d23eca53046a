"""Approximate nearest neighbours with score-aware quantisation (operator 1).

Vectors are scaled to unit length, so the largest cosine is the largest inner product, and
coded by a product quantiser of 16 centers a part, four bits each. Codes and centers are
chosen by the anisotropic loss: the residual's part along the vector, which shifts inner
products, weighs more than the part across it. A query's tables of inner products with
all centers are scanned over the codes, two codes a byte; what the scan ranks high is
scored again with the original vectors, in double precision.

What is coded is a vector's difference from the nearest of a few coarse centers, in units of its own length: a common
offset, a component that outweighs the others and tight clusters are taken away by the coarse centers. Beside the code a vector
has two bytes a component for what the code leaves over. The scan's best of a group are ranked by these bytes before they leave it.

The quantiser is fit on a bounded sample, center by center in small systems, so its time and memory grow
with the dimension only; every vector is coded and searched. Queries meet all codes in blocks: codes are
dealt into groups and queries into blocks, as large as a task's memory allows where there are many, and each
pair of group and block is one task's work. Codes, of two bytes and a quarter for a component, go to every
block and queries, in single precision, to every group; the shortlists grow with the root of the table,
as more vectors come between a query and its neighbours' codes. A query's best of all
groups are joined with their vectors once, and scored.

Defined results: vectors that are null, zero, empty or hold a null or a non-finite component
take no part, neither as queries; vectors are compared within their own dimension; rows are told apart by
their place, so each row of a repeated id is a candidate, and a query of its own that does not find itself
but finds the others; a null id is a candidate and the last at ties; ties go to the smaller id; with fewer
candidates all are returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Cuts, lean, small_batches

#: Vectors in the quantiser's training sample at most, on average over hashes.
SAMPLE = 4096
#: Vectors in a group of the index and queries in a block at most, about.
GROUP, QUERIES = 1 << 19, 1 << 15
#: Bytes of a group's codes at most, about.
GROUP_BYTES = 64 << 20
#: Least groups of an index that has enough vectors, so that small ones are shared out too.
LEAST_GROUPS, LEAST_ROWS = 12, 1024
#: The scan's best per query and group, and per query over all groups, which are scored exactly: at least, for
#: a table of so many vectors; they grow with the root of larger ones.
SHORTLIST, RERANKED, OF = 64, 256, 50_000
#: The scan's best per query and group that are ranked by their bytes: at least, and as a multiple of the group's shortlist.
WIDE, WIDER = 1024, 8
#: Coarse centers at most, and least vectors of the sample for each.
COARSE, COARSE_ROWS, COARSE_ROUNDS = 64, 32, 10
#: Inner products below this matter less: sets the weight of the residual along the vector.
MATTERS = 0.2
FIT_ROUNDS, CODE_ROUNDS = 6, 2


@dataclass
class Quantiser:
    centers: np.ndarray  # (parts, 16, 2)
    weight: float  # of the residual along the vector

    def code(self, x: np.ndarray, rounds: int = CODE_ROUNDS, along: np.ndarray | None = None) -> np.ndarray:
        """Unit vectors (n, 2 * parts) -> (n, parts) codes, part by part with the others as they are.

        ``along`` has the directions in which the residual weighs more, if they are not the vectors' own.
        """
        parts = len(self.centers)
        split = x.reshape(len(x), parts, 2)
        ways = split if along is None else along.reshape(split.shape)
        codes = np.zeros((len(x), parts), np.uint8)
        for s in range(parts):
            codes[:, s] = ((split[:, s, None] - self.centers[s]) ** 2).sum(2).argmin(1)
        left = split - self.centers[np.arange(parts), codes]
        summed = (left * ways).sum((1, 2))
        for _ in range(rounds):
            for s in range(parts):
                rest = summed - (left[:, s] * ways[:, s]).sum(1)
                residual = split[:, s, None] - self.centers[s]
                loss = (residual**2).sum(2) + (self.weight - 1) * (rest[:, None] + (residual * ways[:, s, None]).sum(2)) ** 2
                best = loss.argmin(1)
                codes[:, s], left[:, s] = best, residual[np.arange(len(x)), best]
                summed = rest + (left[:, s] * ways[:, s]).sum(1)
        return codes


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte; parts are even in number."""
    return codes[:, 0::2] | codes[:, 1::2] << 4


def padded(x: np.ndarray) -> np.ndarray:
    """Zero components up to a multiple of four: an even number of parts."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))


def fit(x: np.ndarray, along: np.ndarray | None = None) -> Quantiser:
    """Unit vectors (n, 2 * parts) -> a quantiser; codes and all centers take turns. ``along`` as for ``code``."""
    n, d = x.shape
    parts = d // 2
    share = MATTERS**2
    weight = max(1.0, (d - 1) * share / (1 - share))
    split = x.reshape(n, parts, 2)
    ways = split if along is None else along.reshape(split.shape)
    rng = np.random.default_rng(5)
    centers = np.stack([split[rng.choice(n, 16, replace=n < 16), s] for s in range(parts)])
    for s in range(parts):
        for _ in range(8):
            own = ((split[:, s, None] - centers[s]) ** 2).sum(2).argmin(1)
            for j in range(16):
                if (own == j).any():
                    centers[s, j] = split[own == j, s].mean(0)
    model = Quantiser(centers.astype(np.float64), weight)
    for _ in range(FIT_ROUNDS):
        codes = model.code(x, along=along)
        left = split - model.centers[np.arange(parts), codes]
        summed = (left * ways).sum((1, 2))
        for s in range(parts):
            # a vector has one center of this part, so each center is a system of two unknowns, given the other parts
            own, v, way = codes[:, s], split[:, s], ways[:, s]
            rest = summed - (left[:, s] * way).sum(1)
            sums = lambda w: np.bincount(own, w, 16)  # noqa: B023, E731
            n, xx, xy, yy = sums(np.ones(len(v))) + 1e-6, sums(way[:, 0] ** 2), sums(way[:, 0] * way[:, 1]), sums(way[:, 1] ** 2)
            pull = v + (weight - 1) * (rest + (v * way).sum(1))[:, None] * way
            system = np.stack([np.stack([n + (weight - 1) * xx, (weight - 1) * xy], 1), np.stack([(weight - 1) * xy, n + (weight - 1) * yy], 1)], 1)
            right = np.stack([sums(pull[:, 0]), sums(pull[:, 1])], 1) + 1e-6 * model.centers[s]
            model.centers[s] = np.linalg.solve(system, right[..., None])[..., 0]
            left[:, s] = v - model.centers[s][own]
            summed = rest + (left[:, s] * way).sum(1)
    return model


def scanned(model: Quantiser, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(q, n) approximate inner products by table look-ups, a byte of two codes at a time."""
    tables = np.einsum("qpd,pkd->qpk", queries.reshape(len(queries), -1, 2), model.centers).astype(np.float32)
    pairs = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(len(queries), -1, 256)
    out = np.zeros((len(queries), len(codes)), np.float32)
    for s in range(codes.shape[1]):
        out += pairs[:, s, codes[:, s]]
    return out


@dataclass
class Layered:
    """Coarse centers, and a quantiser of what they leave over."""

    coarse: np.ndarray  # (k, 2 * parts)
    inner: Quantiser

    def width(self) -> int:
        """Bytes of a coded vector: its coarse center, the lengths of both remainders, codes, and two bytes a component."""
        parts = len(self.inner.centers)
        return 12 + parts // 2 + 4 * parts

    def code(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors (n, 2 * parts) -> (n, ``width``) bytes."""
        own = closest(x, self.coarse)
        over, length = _lengths(x - self.coarse[own])
        codes = self.inner.code(over, along=x)
        left = x - self.coarse[own] - length[:, None] * self.inner.centers[np.arange(codes.shape[1]), codes].reshape(x.shape)
        step = (np.abs(left).max(1, initial=0.0) / 32767).astype(np.float32)
        fine = np.rint(left / np.where(step > 0, step, 1)[:, None]).clip(-32767, 32767).astype(np.int16)
        head = [own.astype(np.uint32), length, step]
        return np.concatenate([*(np.ascontiguousarray(h).view(np.uint8).reshape(len(x), 4) for h in head), packed(codes), fine.view(np.uint8)], 1)

    def scan(self, coded: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """(q, n) approximate inner products, without the bytes of what the codes leave over."""
        own, length = self._head(coded, 0, np.uint32), self._head(coded, 4, np.float32)
        near = scanned(self.inner, coded[:, 12 : 12 + len(self.inner.centers) // 2], queries)
        near *= length
        near += (queries @ self.coarse.T).astype(np.float32)[:, own]
        return near

    def refined(self, coded: np.ndarray, query: np.ndarray) -> np.ndarray:
        """(n,) inner products of one query with all that the bytes tell, in double precision."""
        parts = len(self.inner.centers)
        both = coded[:, 12 : 12 + parts // 2]
        codes = np.stack([both & 15, both >> 4], 2).reshape(len(coded), parts)
        tables = np.einsum("pd,pkd->pk", query.reshape(parts, 2), self.inner.centers)
        inner = tables[np.arange(parts), codes].sum(1)
        fine = np.ascontiguousarray(coded[:, 12 + parts // 2 :]).view(np.int16) @ query
        return (self.coarse @ query)[self._head(coded, 0, np.uint32)] + self._head(coded, 4, np.float32) * inner + self._head(coded, 8, np.float32) * fine

    @staticmethod
    def _head(coded: np.ndarray, at: int, kind: type) -> np.ndarray:
        return np.ascontiguousarray(coded[:, at : at + 4]).view(kind)[:, 0]


def closest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each row the nearest center."""
    return ((centers**2).sum(1) - 2 * (x @ centers.T)).argmin(1)


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to unit length, and their lengths; zero rows stay."""
    length = np.linalg.norm(x, axis=1).astype(np.float32)
    return x / np.where(length > 0, length, 1)[:, None], length


def layered(x: np.ndarray) -> Layered:
    """Unit vectors (n, 2 * parts) -> coarse centers, seeded far apart and moved to their vectors' means, and a quantiser of the differences."""
    rng = np.random.default_rng(7)
    coarse = x.mean(0, keepdims=True)
    far = ((x - coarse) ** 2).sum(1)
    seeds = []
    for _ in range(min(COARSE, len(x) // COARSE_ROWS)):
        if not far.sum() > 0:
            break
        seeds.append(x[rng.choice(len(x), p=far / far.sum())])
        gap = ((x - seeds[-1]) ** 2).sum(1)
        far = gap if len(seeds) == 1 else np.minimum(far, gap)
    if len(seeds) > 1:
        coarse = np.stack(seeds)
        for _ in range(COARSE_ROUNDS):
            own = closest(x, coarse)
            for j in np.unique(own):
                coarse[j] = x[own == j].mean(0)
    over, _ = _lengths(x - coarse[closest(x, coarse)])
    return Layered(coarse, fit(over, along=x))


def shortlisted(model: Layered, own: np.ndarray, q: np.ndarray, rows: np.ndarray, coded: np.ndarray, short: int):
    """Yields (query's row, places, scores): of ``rows``, in the order of ties, each query's best by the scan and then by their bytes."""
    unit_q = padded(q / np.linalg.norm(q, axis=1, keepdims=True))
    wide = max(WIDE, WIDER * short)
    for at in range(0, len(q), 64):
        queries, best = unit_q[at : at + 64], [[] for _ in q[at : at + 64]]
        for first in range(0, len(rows), 1 << 15):  # 64 queries' scores of so many codes are in memory
            near = model.scan(coded[first : first + (1 << 15)], queries)
            for i, row in enumerate(near):
                row[rows[first : first + len(row)] == own[at + i]] = -np.inf
                least = -np.partition(-row, wide - 1)[wide - 1] if len(row) > wide else -np.inf
                chosen = np.flatnonzero((row >= least) & (row > -np.inf))
                if len(chosen) > wide:
                    chosen = np.sort(chosen[np.argsort(-row[chosen], kind="stable")][:wide])
                best[i].append((first + chosen, row[chosen]))
        for i, found in enumerate(best):
            places, scores = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(places) > wide:
                places = np.sort(places[np.argsort(-scores, kind="stable")][:wide])
            scores = model.refined(coded[places], queries[i])
            chosen = np.argsort(-scores, kind="stable")[:short]
            yield own[at + i], places[chosen], scores[chosen]


def scored(batches):
    """(query's row, id, candidate's row, id, vector of the query, of the candidate) -> the first four and the cosine."""
    for batch in batches:
        score = np.zeros(0)
        if batch.num_rows:
            x, y = _matrix(batch.column(4)), _matrix(batch.column(5))
            score = np.einsum("nd,nd->n", x, y) / (np.sqrt(np.einsum("nd,nd->n", x, x)) * np.sqrt(np.einsum("nd,nd->n", y, y)))
        yield pa.record_batch([*(batch.column(k) for k in range(4)), pa.array(score)], names=["q", "query_id", "r", "vec_id", "score"])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(r, id, v array<double>, d): the rows whose vector takes part, numbered."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("v is not null")
    rows = rows.where(~bad & F.exists("v", lambda c: c != 0))
    return rows.select(F.monotonically_increasing_id().alias("r"), "id", "v", F.size("v").alias("d"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query and rank: ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (cosine of the original vectors).

    ``is_query`` is a condition on ``id``.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = Cuts(spark, "vectors").write(usable(vectors, key, vector))
    counts = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()
    found = None
    for d, n, q in sorted(counts):
        if not q:
            continue
        own = rows.where(F.col("d") == d)
        place = F.pmod(F.xxhash64(F.lit("ann"), F.col("r")), F.lit(1 << 30)) / float(1 << 30)
        sample = own.where(place < min(1.0, SAMPLE / n)).orderBy("r").select("v").toArrow() if n > 1 else own.select("v").toArrow()
        if not sample.num_rows:
            sample = own.orderBy("r").limit(SAMPLE).select("v").toArrow()
        x = _matrix(sample.column(0))
        model = spark.sparkContext.broadcast(layered(padded(x / np.linalg.norm(x, axis=1, keepdims=True))))
        got = _searched(own, is_query, model, n, q, model.value.width())
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(own: DataFrame, is_query: Column, model, n: int, q: int, width: int) -> DataFrame:
    groups = max(-(-n // max(1, min(GROUP, GROUP_BYTES // width))), min(LEAST_GROUPS, -(-n // LEAST_ROWS)))
    blocks = -(-q // QUERIES)
    reranked = round(RERANKED * max(1.0, (n / OF) ** 0.5))
    short = max(SHORTLIST, 3 * reranked // groups)
    g = F.pmod(F.xxhash64(F.lit(1), F.col("r")), F.lit(groups)).cast("int")
    b = F.pmod(F.xxhash64(F.lit(2), F.col("r")), F.lit(blocks)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def coded(batches):
        for batch in batches:
            x = _matrix(batch.column(3))
            codes = model.value.code(padded(x / np.linalg.norm(x, axis=1, keepdims=True))) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary())], names=["g", "r", "id", "code"])

    index = own.select(g.alias("g"), "r", "id", "v").mapInArrow(lean(coded), "g int, r long, id long, code binary")
    index = index.select("g", every(blocks).alias("b"), "r", "id", "code")
    asked = own.where(is_query).select(every(groups).alias("g"), b.alias("b"), "r", F.col("v").cast("array<float>").alias("v"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by([("id", "ascending"), ("r", "ascending")])  # ties; nulls are last
            codes = _bytes(left.column("code")).reshape(left.num_rows, -1)
            rows = left.column("r").to_numpy()
            for one, places, near in shortlisted(model.value, right.column("r").to_numpy(), _matrix(right.column("v")).astype(np.float64), rows, codes, short):
                for c, own_ in zip(out, (np.full(len(places), one), rows[places], places, near), strict=True):
                    c.append(own_)
        q, r, places, near = (np.concatenate(c) if c else np.zeros(0) for c in out)
        ids = left.column("id").combine_chunks().take(pa.array(places.astype(np.int64)))
        return pa.table({"q": pa.array(q.astype(np.int64)), "r": pa.array(r.astype(np.int64)), "vec_id": ids, "near": pa.array(near.astype(np.float64))})

    found = index.groupBy("g", "b").cogroup(asked.groupBy("g", "b")).applyInArrow(search, "q long, r long, vec_id long, near double")
    order = Window.partitionBy("q").orderBy(F.desc("near"), F.asc_nulls_last("vec_id"), "r")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= reranked).select("q", "r", "vec_id")
    candidates = best.join(own.select("r", F.col("v").alias("y")), "r")
    both = candidates.join(own.where(is_query).select(F.col("r").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("x")), "q").select("q", "query_id", "r", "vec_id", "x", "y")
    return both.mapInArrow(lean(scored), "q long, query_id long, r long, vec_id long, score double")

