"""Exact centroid clustering of integer vectors with grouped distance bounds (operator 13).

Each round is Lloyd's: every vector goes to its nearest centroid, then centroids move to the
floor of their vectors' mean. A vector carries its cluster, an upper bound on the distance to
that centroid, and for each group of centroids one lower bound on the distance to the
group's others. When centroids move, the bounds give way by as much. A vector whose upper bound is
below all lower bounds stays without a look (global filter); of the rest, after the upper
bound is made exact, only groups whose lower bound is not above it are scanned (group
filter), all their centroids exactly. The groups are made once, of the first centroids.

Distances are whole numbers, so results are exact; bounds are doubles, widened by more than their
rounding, and a tie is never filtered, because the smaller number wins it.

Each round writes the vectors with their bounds and reads the table of the round before,
which is then deleted, so lost executors cost at most a round. Only sums per cluster and task are
shuffled, and only centroids and those sums reach the driver: their number times the
dimension, whatever the table is.

Defined results: vectors of another dimension, null, or with a null or non-finite component take
no part; rows that repeat an id are vectors of their own; a null id is last among the
starting hashes and its vector takes part; vectors with one hash start in the order of their components;
with fewer vectors than centroids each is one; equal centroids are kept, the smaller number gets the
vectors; an empty table gives no rows; extra columns are ignored; a component beyond 2^27
after scaling is an error, since distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Cuts, give_back, lean, small_batches

#: Components are whole multiples of one in so many, and stay below this.
SCALE, MOST = 1024, 1 << 27
#: Centroids in a group, about.
PER_GROUP = 4
#: Bounds are widened by this share, far more than what doubles round.
SLACK = 1e-12

STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>, distance long"


@dataclass
class Centroids:
    """Places (k, d) as whole numbers, each one's group, and how far each has moved since the round before."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    def after(self, at: np.ndarray) -> Centroids:
        step = np.sqrt(((at - self.at).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        return Centroids(at, self.group, step)


def grouped(at: np.ndarray) -> np.ndarray:
    """A group for each centroid: a few rounds of means over the centroids themselves."""
    wanted = -(-len(at) // PER_GROUP)
    means = at[:: max(1, len(at) // max(wanted, 1))][:wanted].astype(np.float64)
    own = np.zeros(len(at), int)
    for _ in range(5):
        own = ((at[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([at[own == g].mean(0) if (own == g).any() else means[g] for g in range(len(means))])
    return np.unique(own, return_inverse=True)[1].reshape(-1)


def squared(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    step = x - center
    return np.einsum("nd,nd->n", step, step)


def assigned(c: Centroids, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves vectors (n, d) to their nearest centroid, in place; returns how many distances it took."""
    upper[:] = (upper + c.moved[cluster]) * (1 + SLACK)
    away = np.array([c.moved[c.group == g].max() for g in range(lower.shape[1])])
    lower[:] = lower - away - SLACK * (np.abs(lower) + away)
    rows = np.flatnonzero(upper >= lower.min(1))
    took = len(rows)
    if not took:
        return 0
    # unknown distances count as the largest number, so they never win
    old, far = cluster[rows], np.full((took, len(c.at)), np.iinfo(np.int64).max)
    for j in np.unique(old):
        far[old == j, j] = squared(x[rows[old == j]], c.at[j])
    here = np.sqrt(far[np.arange(len(rows)), old].astype(np.float64))
    scan = lower[rows] <= (here * (1 + SLACK))[:, None]
    for j, g in enumerate(c.group):
        hit = np.flatnonzero(scan[:, g] & (old != j))
        far[hit, j] = squared(x[rows[hit]], c.at[j])
        took += len(hit)
    to = far.argmin(1)  # at ties the smaller number
    best = far[np.arange(len(rows)), to]
    far[np.arange(len(rows)), to] = np.iinfo(np.int64).max
    for g in range(lower.shape[1]):
        others = np.sqrt(far[:, c.group == g].min(1).astype(np.float64)) * (1 - SLACK)
        lower[rows, g] = np.where(scan[:, g], others, np.minimum(lower[rows, g], others))
    cluster[rows], upper[rows] = to, np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    return took


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(values.ravel(), kind))


def whole_vectors(vectors: DataFrame, dimension: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>): the vectors that take part, scaled and floored."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == dimension)
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    large = F.raise_error(F.lit("a component is too large for exact distances"))
    return rows.select("vec_id", F.transform("v", lambda c: F.when(F.abs(c) < MOST // SCALE, F.floor(c * SCALE).cast("int")).otherwise(large.cast("int"))).alias("v"))


def _starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def _next(rows: DataFrame, c: Centroids) -> Centroids:
    """Centroids at the floor of their vectors' means; each task sends one row per cluster and component."""
    k, d = c.at.shape

    def sums(batches):
        total, n = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                own, x = batch.column(0).to_numpy(), _matrix(batch.column(1), np.int64)
                for j in range(k):
                    total[j] += x[own == j].sum(0)
                n += np.bincount(own, minlength=k)
        yield pa.record_batch([pa.array(np.arange(k), pa.int32()), pa.array(n), _lists(total, pa.int64())], names=["cluster", "n", "sums"])

    parts = rows.select("cluster", "v").mapInArrow(lean(sums), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    at = c.at.copy()
    for r in each.where("n > 0").collect():
        at[r.cluster, r.i] = int(r.s) // r.n
    return c.after(at)


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dimension: int = 64, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance squared), centroids (k, d)) after ``rounds`` rounds and a last assignment."""
    spark = vectors.sparkSession
    small_batches(spark)
    cuts = Cuts(spark, "yinyang")
    whole = cuts.write(whole_vectors(vectors, dimension, key, vector))
    at = _starts(whole, k, seed)
    if not len(at):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dimension), np.int64)
    c = Centroids(at, grouped(at), np.zeros(len(at)))
    groups = int(c.group.max()) + 1
    state = whole.select("*", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array(*[F.lit(0.0)] * groups).alias("lower"), F.lit(0).cast("long").alias("distance"))

    def assign(rows: DataFrame, c: Centroids, last: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, lower = _matrix(batch.column(1), np.int64), _matrix(batch.column(4), np.float64)
                cluster, upper = np.array(batch.column(2)), np.array(batch.column(3))
                assigned(c, x, cluster, upper, lower)
                distance = squared(x, c.at[cluster]) if last else np.zeros(len(x), np.int64)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower, pa.float64()), pa.array(distance)], names=[f.split()[0] for f in STATE.split(", ")])

        return rows.mapInArrow(lean(run), STATE)

    before = whole
    for _ in range(rounds):
        state = cuts.write(assign(state, c, False))
        cuts.drop(before)
        before, c = state, _next(state, c)
        if not c.moved.any():
            break  # all further rounds would leave everything as it is
    final = cuts.write(assign(state, c, True).select("vec_id", "cluster", "distance"))
    cuts.drop(before)
    give_back()
    return final, c.at


def digest(vectors: DataFrame) -> DataFrame:
    rows, at = clustered(vectors)
    spark = vectors.sparkSession
    said = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(at.tolist())]
    # a row for each centroid
    own = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    own = own.join(F.broadcast(spark.createDataFrame(said, "cluster int, centroid_sha256 string")), "cluster")
    own = own.crossJoin(F.broadcast(own.agg(F.sum("cluster_inertia").alias("inertia"))))
    return rows.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Lloyd's rounds written out, over rows of (vector, component)."""
    parts = [
        """kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
first AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < 8),
c0 AS (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM first)"""
    ]
    for k in range(11):
        parts.append(f"a{k} AS (SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{k} USING (i) GROUP BY r, c) GROUP BY r)")
        if k < 10:
            parts.append(
                f"m{k} AS (SELECT best.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (r) GROUP BY best.c, i),\n"
                f"c{k + 1} AS (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{k} LEFT JOIN m{k} USING (c, i))"
            )
    parts.append("said AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY c)")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256\n"
        "FROM a10 JOIN kept USING (r) JOIN said ON said.c = best.c"
    )


ORACLE_SQL = _oracle()
