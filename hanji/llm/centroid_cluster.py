"""Lloyd's clustering with Drake's adaptive bounds, in exact integers (operator 11).

Vectors are turned into integers once. Every vector carries its cluster, an upper bound on its distance there, lower bounds
on its distances to the next few centroids by name, and one lower bound on all others. When centroids have moved, bounds
widen by how far; where the upper bound is below all lower ones, no distance is computed. Otherwise the distance to
the own centroid is computed, and if that does not certify the order, those to as many of the named centroids as bounds
leave open; only where the bound on the others fails too are all centroids scanned. Bounds are rounded outwards and
compared strictly, so ties, which go to the smaller number, are always settled on exact distances. The number of
named centroids shrinks to what the round before has needed, but not below an eighth of all.

A round is one pass of Arrow batches over the vectors, whose state is written to the shared folder, and one sum per
cluster and component; what reaches the driver, and is sent back, are the centroids.

Defined cases: vectors that are null, of another length, or have a null, NaN or infinite component are left out;
null ids stand last in the choice of the first centroids, and rows that share an id by their components; repeated
rows are vectors of their own (of two equal first centroids the second stays empty); with fewer vectors than centroids
there are as many centroids as vectors; an empty table gives no rows; extra columns, whatever their names, are ignored.
Integers so large that squared distances might pass 64 bits are refused with an error, not rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanji.llm.common import read, release, settle

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Named centroids at first, and at least, as shares of all.
NAMED, LEAST_NAMED = 4, 8
#: Relative error that covers one square root and one conversion; a sum's error is covered by one step outwards.
SLACK = 1e-15
STATE = "key long, v array<int>, cluster int, upper double, near array<int>, low array<double>, depth int, distance long"


def largest(size: int) -> int:
    """The largest component for which squared distances surely fit 62 bits."""
    return min((1 << 31) - 1, isqrt((1 << 62) // (4 * size)) - 1)


def quantized(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(key, v) of the usable vectors: ``floor(scale * x)`` of each component in double precision."""
    v = F.col(vector)
    sound = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.abs(x.cast("double") * scale) < largest(size)
    exact = F.transform(v, lambda x: F.when(fits(x), whole(x)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")).cast("int"))
    return vectors.filter(v.isNotNull() & sound).select(F.col(key).cast("long").alias("key"), exact.alias("v"))


def first_centroids(points: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id."""
    named = points.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256).alias("h"))
    return [list(r["v"]) for r in named.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``; in floating point while that is exact."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    dot = (x.astype(float) @ c.T.astype(float)).astype(np.int64) if peak * peak * x.shape[1] < 1 << 52 else x @ c.T
    return (x * x).sum(1)[:, None] - 2 * dot + (c * c).sum(1)


def above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 + SLACK)


def below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 - SLACK)


class State:
    """Vectors of a batch with their clusters and bounds; ``low`` has a column for the unnamed centroids at its end."""

    def __init__(self, x: np.ndarray, named: int):
        n = len(x)
        self.x, self.cluster, self.upper = x, np.zeros(n, np.int32), np.full(n, np.inf)
        self.near, self.low = np.zeros((n, named), np.int32), np.full((n, named + 1), -np.inf)
        self.depth = np.zeros(n, np.int32)

    def name_fewer(self, named: int) -> None:
        """Keep ``named`` bounds; the others join the bound on the rest."""
        self.low = np.concatenate((self.low[:, :named], self.low[:, named:].min(1, keepdims=True)), 1)
        self.near = self.near[:, :named]

    def widen(self, moved: np.ndarray) -> None:
        """Make up for centroids that have moved so far."""
        self.upper = np.nextafter(self.upper + moved[self.cluster], np.inf)
        by = np.concatenate((moved[self.near], np.full((len(self.x), 1), moved.max())), 1)
        self.low = np.nextafter(self.low - by, -np.inf)

    def open_names(self, rows: np.ndarray) -> np.ndarray:
        """How many of the named centroids may be nearest, counted in their order; one more than all: others may be, too."""
        lowest = np.minimum.accumulate(self.low[rows, ::-1], axis=1)[:, ::-1]
        return (self.upper[rows, None] >= lowest).sum(1)

    def settle(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Assign ``rows`` to the nearest of the candidates ``ids`` and name the next ones in order."""
        place = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, place, 1), np.take_along_axis(d, place, 1)
        self.cluster[rows], self.upper[rows] = ids[:, 0], above(d[:, 0])
        n = min(ids.shape[1] - 1, self.near.shape[1])
        self.near[rows, :n], self.low[rows, :n] = ids[:, 1 : n + 1], below(d[:, 1 : n + 1])

    def scan(self, rows: np.ndarray, c: np.ndarray) -> None:
        """Exact distances to all centroids."""
        if not len(rows):
            return
        named, d = self.near.shape[1], squares(self.x[rows], c)
        self.low[rows] = np.inf
        self.settle(rows, np.broadcast_to(np.arange(len(c), dtype=np.int32), d.shape), d)
        if len(c) > named + 1:
            self.low[rows, named] = below(np.partition(d, named + 1, axis=1)[:, named + 1])

    def assign(self, c: np.ndarray) -> None:
        """The nearest centroid of every vector, computing what the bounds leave open."""
        named = self.near.shape[1]
        rows = np.flatnonzero(self.open_names(np.arange(len(self.x))))
        self.upper[rows] = above(self.own(rows, c))
        self.depth[:] = 0
        self.depth[rows] = self.open_names(rows)
        for depth in range(1, named + 1):
            some = np.flatnonzero(self.depth == depth)
            if len(some):
                ids = np.sort(np.concatenate((self.cluster[some, None], self.near[some, :depth]), 1), axis=1)
                gap = self.x[some, None, :] - c[ids]
                self.settle(some, ids, (gap * gap).sum(2))
        self.scan(np.flatnonzero(self.depth == named + 1), c)

    def own(self, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        gap = self.x[rows] - c[self.cluster[rows]]
        return (gap * gap).sum(1)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def assigned(rows: DataFrame, centers: np.ndarray, moved: np.ndarray | None, named: int) -> DataFrame:
    """One round's assignment: of bare points where ``moved`` is null, else of the state that the round before left."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            state = State(_matrix(batch.column("v"), n).astype(np.int64), named)
            if moved is None:
                state.scan(np.arange(n), centers)
                state.depth[:] = named + 1
            else:
                state.cluster, state.upper = batch.column("cluster").to_numpy().copy(), batch.column("upper").to_numpy().copy()
                low = _matrix(batch.column("low"), n).copy()
                state.near, state.low = (_matrix(batch.column("near"), n).copy() if low.shape[1] > 1 else np.zeros((n, 0), np.int32)), low
                state.name_fewer(named)
                state.widen(moved)
                state.assign(centers)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("v"), pa.array(state.cluster), pa.array(state.upper), _lists(state.near), _lists(state.low), pa.array(state.depth), pa.array(state.own(np.arange(n), centers))],
                names=[c.split()[0] for c in STATE.split(", ")],
            )
        release()

    return rows.mapInArrow(work, STATE)


def moved_centers(state: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, int]:
    """The floor of each cluster's mean, and the largest depth that the round needed. One row a cluster reaches the driver."""
    size = centers.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(size)]).collect()
    new = centers.copy()
    for r in sums:
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return new, max(r["depth"] for r in sums)


def cluster(points: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, *, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """State rows of the last assignment (key, v, cluster, distance, bounds), and the centroids, from (key, v)."""
    points = settle(points)
    centers = np.array(first_centroids(points, k, seed), np.int64)
    if not len(centers):
        return points.sparkSession.createDataFrame([], STATE), centers.reshape(0, 0)
    named = min(max(1, k // NAMED), len(centers) - 1)
    state = settle(assigned(points, centers, None, named))
    for _ in range(rounds):
        new, depth = moved_centers(state, centers)
        gap = (new - centers).astype(object)
        moved = np.array([float(s) ** 0.5 * (1 + 2 * SLACK) for s in (gap * gap).sum(1)])
        named = min(named, max(k // LEAST_NAMED, min(depth, named)))
        centers = new
        state = settle(assigned(state, centers, moved, named))
    return state, centers


def op11_centroid_cluster(spark, sf_dir: str) -> DataFrame:
    state, centers = cluster(quantized(read(spark, sf_dir, "embeddings")))
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centers)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    named = state.select(F.col("key").alias("vec_id"), "cluster", "distance")
    return named.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    """An assignment to the centroids c{r}, and the centroids after it."""
    return f"""
a{r} AS MATERIALIZED (SELECT rid, min(d * 16 + c) % 16 AS c, min(d * 16 + c) // 16 AS d FROM (SELECT rid, c, list_sum(list_transform(list_zip(k.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM kept k, c{r}) GROUP BY rid),
s{r} AS (SELECT c, i, sum(x) AS s, count(*)::HUGEINT AS n FROM (SELECT a.c, unnest(range(1, 65)) AS i, unnest(k.v) AS x FROM kept k JOIN a{r} a USING (rid)) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"""


OP11_SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept ORDER BY sha256('1:' || vec_id) NULLS LAST, v LIMIT 16),
{",".join(_round_sql(r) for r in range(3))},
{_round_sql(3).partition("s3 AS")[0].rstrip().rstrip(",")}
SELECT vec_id, a3.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a3.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM kept JOIN a3 USING (rid) JOIN c3 ON c3.c = a3.c"""
