"""A partitioned vector index: coarse cells, residual product codes, vectors stored by cell, incremental loads.

Cells are k-means centres of a bounded sample, trained by Spark's own k-means. What a vector differs from its cell's centre
by is coded in parts: each part of the residual is replaced by the nearest of at most 256 code vectors, trained a part a
task on the same sample. Codes and vectors are tables of their own, both partitioned by cell, so that a query reads
the codes of the cells it probes and the vectors of few candidates.

The squared distance to a coded vector is ``|q - c|^2 + bias - 2 q.r``: the first term is a number a cell, the bias
(``|r|^2 + 2 c.r``) is stored with the code, and ``q.r`` is a sum of looked-up numbers, one a part. One query is a single plan of
built-in functions; many queries meet the codes in blocks by cell. Candidates are then ranked by exact distances.
:meth:`VectorIndex.nearest` is exact: a cell whose centre is farther than the k-th distance found plus the cell's radius
cannot hold a nearer vector, and is not read.

Loads, deletions and rebuilding are versions (:mod:`hanji.sources.versions`); nothing written is changed. Vectors that are
null, of another length, or have a null, NaN or infinite component are not indexed; rows that share an id are vectors of
their own, and all go when the id is deleted; ties go by id; an index without vectors finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanji import config
from hanji.operators.retrieve import squared_l2
from hanji.sources.versions import Versions, stored

#: Vectors that training reads, about, and cells at most: both bound what the driver and a training task hold.
SAMPLE, MOST_CELLS = 65_536, 4096
PARTS, CODES = 16, 256
#: Queries of a block, and rows of a pack of codes, that meet in a task at once.
BLOCK, PACK = 256, 8192
#: Numbers of a matrix that a task makes at once, and bytes of the rows that it is sent at once.
CELLS, BATCH_BYTES = 1 << 21, 16 << 20
#: Candidates for each result that is asked for; vectors whose neighbours say how many cells to probe.
CANDIDATES, TRIAL = 20, 200
#: Rebuilding is due when the index has grown by this factor since it was trained.
GROWTH = 4


def usable(vector: str, size: int) -> Column:
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows whose matrices of so many columns have about :data:`CELLS` numbers."""
    step = max(1, CELLS // max(1, width))
    return (slice(a, a + step) for a in range(0, rows, step))


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[_gaps(x[s], c).argmin(1) for s in _slices(len(x), len(c))]])


def _listed(column: pa.Array, row: int, *fields: str) -> list[pa.Array]:
    """The fields of the structs in one row's list."""
    structs = column[row].values
    return [structs.field(f) for f in fields]


def _codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means of one part's sample, in a task."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = _closest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


class Model:
    """Cell centres and codebooks. ``bounds`` are the parts' first and last components."""

    def __init__(self, centers: np.ndarray, books: list[np.ndarray]):
        self.centers, self.books = centers, books
        edges = np.cumsum([0, *[b.shape[1] for b in books]])
        self.bounds = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, bias, distance to the cell's centre) of each row."""
        cell = _closest(x, self.centers)
        residual = x - self.centers[cell]
        codes = np.stack([_closest(residual[:, a:b], book) for (a, b), book in zip(self.bounds, self.books, strict=True)], 1)
        coded = self.decoded(codes)
        return cell, codes, (coded * coded).sum(1) + 2 * (coded * self.centers[cell]).sum(1), np.sqrt((residual * residual).sum(1))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)

    def lookup(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part, the inner products of all queries with all its codes."""
        return [q[:, a:b] @ book.T for (a, b), book in zip(self.bounds, self.books, strict=True)]


def train(vectors: DataFrame, *, size: int, cells: int | None = None, parts: int = PARTS, sample: int = SAMPLE, seed: int = 7) -> tuple[Model | None, int]:
    """A model of (doc_id, embedding), and how many usable vectors there were. About ``sample`` of them, drawn by hash, are read."""
    rows = vectors.filter(usable("embedding", size)).select(F.xxhash64("doc_id", "embedding").alias("h"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = rows.count()
    if not n:
        return None, 0
    drawn = rows.filter(F.pmod("h", F.lit(1 << 30)) <= int(min(1.0, sample / n) * (1 << 30))).select("v", array_to_vector("v").alias("features")).persist()
    try:
        k = min(cells or ceil(sqrt(n)), MOST_CELLS, n)
        # k-means|| chooses at most k centres, fewer where there are fewer distinct vectors.
        centers = np.array(KMeans(k=k, seed=seed, maxIter=15).fit(drawn).clusterCenters()) if k > 1 else np.array([drawn.agg(*[F.avg(F.col("v")[i]) for i in range(size)]).first()])
        edges = np.linspace(0, size, min(parts, size) + 1).astype(int).tolist()

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("v"), batch.num_rows)
                x = x - centers[_closest(x, centers)]
                for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([j] * len(x), pa.int32()), "v": pa.array(list(x[:, a:b]), pa.list_(pa.float64()))})

        def book(part: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            c = _codebook(np.stack(frame["v"].to_numpy()), CODES, seed + int(part[0]))
            return pd.DataFrame({"part": part[0], "code": range(len(c)), "v": list(c)})

        got = drawn.select("v").mapInArrow(pieces, "part int, v array<double>").groupBy("part").applyInPandas(book, "part int, code int, v array<double>").collect()
    finally:
        drawn.unpersist()
    books = [np.array([r["v"] for r in sorted((r for r in got if r["part"] == j), key=lambda r: r["code"])]) for j in range(len(edges) - 1)]
    return Model(centers, books), n


class VectorIndex:
    """The index below ``root`` at its newest version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.versions = spark, root.rstrip("/"), Versions(spark, root)
        self.version, self.state = self.versions.newest()
        self.loads: dict[str, dict] = self.state.get("loads", {})
        self._model: Model | None = None

    def refreshed(self) -> VectorIndex:
        return VectorIndex(self.spark, self.root)

    @property
    def model(self) -> Model:
        """Centres and codebooks: at most ``MOST_CELLS + CODES`` vectors."""
        if self._model is None:
            rows = self.spark.read.parquet(f"{self.root}/models/{self.state['model']}").collect()
            pick = lambda part: np.array([r["v"] for r in sorted((r for r in rows if r["part"] == part), key=lambda r: r["code"])])
            self._model = Model(pick(-1), [pick(j) for j in range(self.state["parts"])])
        return self._model

    # Changes

    def build(self, vectors: DataFrame, *, size: int | None = None, **how) -> VectorIndex:
        """Train on (doc_id, embedding) and load them, in place of all that was there."""
        if size is None:
            counts = vectors.groupBy(F.size("embedding").alias("size")).count().filter("size > 0").orderBy(F.col("count").desc(), "size").first()
            size = counts["size"] if counts else 0
        model, n = train(vectors, size=size, **how)
        if model is None:
            self.versions.commit(self.version, {"size": size})
            return self.refreshed()
        name = uuid.uuid4().hex
        rows = [(-1, i, c.tolist()) for i, c in enumerate(model.centers)] + [(j, i, c.tolist()) for j, b in enumerate(model.books) for i, c in enumerate(b)]
        self.spark.createDataFrame(rows, "part int, code int, v array<double>").coalesce(1).write.parquet(f"{self.root}/models/{name}")
        self._model = model
        state = {"model": name, "size": size, "parts": len(model.books), "trained": n, "id_type": vectors.schema["doc_id"].dataType.simpleString()}
        self.versions.commit(self.version, {**state, "loads": self._load(vectors, state)})
        return self.refreshed()

    def rebuild(self, **how) -> VectorIndex:
        """Train anew on the vectors that are there, and store them by the new cells."""
        return self.build(self.vectors().select("doc_id", "embedding"), size=self.state["size"], **how)

    def is_outgrown(self) -> bool:
        return sum(v["rows"] - v["gone"] for v in self.loads.values()) > GROWTH * self.state.get("trained", 0)

    def _load(self, vectors: DataFrame, state: dict) -> dict[str, dict]:
        name, model = uuid.uuid4().hex, self.model
        at = [f"c{j}" for j in range(len(model.books))]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, codes, bias, far = model.encode(_matrix(batch.column("embedding"), batch.num_rows))
                    columns = [batch.column("doc_id"), batch.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(bias), pa.array(far), *[pa.array(codes[:, j].astype(np.int16)) for j in range(len(at))]]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "embedding", "cell", "bias", "far", *at])

        chosen = vectors.filter(usable("embedding", state["size"])).select("doc_id", F.col("embedding").cast("array<float>").alias("embedding"))
        schema = f"doc_id {state['id_type']}, embedding array<float>, cell int, bias double, far double, {', '.join(f'{c} short' for c in at)}"
        # Dealt by cell, large cells split; written once, so that the numbers of rows stay.
        coded = chosen.mapInArrow(work, schema).hint("rebalance", "cell").sortWithinPartitions("cell").withColumn("row", F.monotonically_increasing_id())
        coded.write.partitionBy("cell").parquet(f"{self.root}/vectors/load={name}")
        rows = self.spark.read.parquet(f"{self.root}/vectors/load={name}")
        rows.select("row", "doc_id", "bias", *at, "cell").write.partitionBy("cell").parquet(f"{self.root}/codes/load={name}")
        cells = {str(r["cell"]): [r["n"], r["radius"]] for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
        return {name: {"rows": sum(n for n, _ in cells.values()), "gone": 0, "dead": [], "cells": cells}} if cells else {}

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Load more vectors under the codes that are there; vectors with the same ids go."""
        if not self.loads:
            return self.build(vectors, size=self.state.get("size") or None)
        loads = self._bury(vectors) | self._load(vectors, self.state)
        self.versions.commit(self.version, {**self.state, "loads": loads})
        return self.refreshed()

    def delete(self, ids: DataFrame) -> VectorIndex:
        self.versions.commit(self.version, {**self.state, "loads": self._bury(ids)})
        return self.refreshed()

    def _bury(self, ids: DataFrame) -> dict[str, dict]:
        name = uuid.uuid4().hex
        found = self._codes().select("load", "row", "doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        found.select("load", "row").write.parquet(f"{self.root}/dead/{name}")
        gone = {r["load"]: r["n"] for r in self.spark.read.parquet(f"{self.root}/dead/{name}").groupBy("load").agg(F.count("*").alias("n")).collect()}
        loads = {x: v | {"gone": v["gone"] + gone[x], "dead": [*v["dead"], name]} if x in gone else v for x, v in self.loads.items()}
        return {x: v for x, v in loads.items() if v["gone"] < v["rows"]}

    # Tables

    def _table(self, kind: str, columns: str) -> DataFrame:
        schema = f"{columns}, load string, cell int"
        if not self.loads:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", f"{self.root}/{kind}").schema(schema).parquet(*[f"{self.root}/{kind}/load={x}" for x in sorted(self.loads)])
        dead = sorted({t for v in self.loads.values() for t in v["dead"]})
        if not dead:
            return rows
        return rows.join(self.spark.read.schema("load string, row long").parquet(*[f"{self.root}/dead/{t}" for t in dead]), ["load", "row"], "left_anti")

    def _codes(self) -> DataFrame:
        return self._table("codes", f"row long, doc_id {self.state.get('id_type', 'long')}, bias double, " + ", ".join(f"c{j} short" for j in range(self.state.get("parts", 1))))

    def vectors(self) -> DataFrame:
        """(doc_id, embedding, load, row, cell) of all vectors that are not deleted."""
        return self._table("vectors", f"row long, doc_id {self.state.get('id_type', 'long')}, embedding array<float>")

    def _radius(self) -> dict[int, float]:
        out: dict[int, float] = {}
        for v in self.loads.values():
            for cell, (_, radius) in v["cells"].items():
                out[int(cell)] = max(out.get(int(cell), 0.0), radius)
        return out

    # Searches

    def cells_by_distance(self, query: list[float]) -> list[tuple[float, int]]:
        """(distance of the centre, cell) of the cells that have vectors, nearest first."""
        far = np.sqrt(_gaps(np.asarray([query], float), self.model.centers)[0])
        return sorted((float(far[c]), c) for c in self._radius())

    def probes_for(self, recall: float, k: int = 10, trial: int = TRIAL) -> int:
        """How many cells to probe so that they hold this share of the k nearest, judged on about ``trial`` stored vectors.

        How many it takes depends on the data: few where vectors lie in clusters, most of them where they are random.
        """
        rows = self.vectors().select(F.xxhash64("load", "row").alias("doc_id"), "embedding", "cell")
        total = sum(v["rows"] - v["gone"] for v in self.loads.values())
        if not total:
            return 1
        tried = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(min(1.0, trial / total) * (1 << 30))).select(F.col("doc_id").alias("query_id"), "embedding")
        near = nearest_many(tried, rows.select("doc_id", "embedding"), k, size=self.state["size"])
        got = near.join(rows.select("doc_id", "cell"), "doc_id").join(tried, "query_id").select("embedding", "cell").collect()
        if not got:
            return len(self._radius())
        known = np.array(sorted(self._radius()))
        place = np.argsort(np.argsort(_gaps(np.array([r["embedding"] for r in got], float), self.model.centers[known]), axis=1, kind="stable"), axis=1)
        needed = np.sort(place[np.arange(len(got)), np.searchsorted(known, [r["cell"] for r in got])]) + 1
        return int(needed[min(len(needed), ceil(recall * len(needed))) - 1])

    def search(self, query: list[float], k: int, *, nprobe: int = 8, candidates: int | None = None) -> DataFrame:
        """(doc_id, distance) of about the k nearest: codes of ``nprobe`` cells, then exact squared distances of the best candidates."""
        if not self.loads:
            return self.vectors().select("doc_id", F.lit(0.0).alias("distance")).limit(0)
        near = self.cells_by_distance(query)[:nprobe]
        table = self.model.lookup(np.asarray([query], float))
        known = F.create_map(*[F.lit(x) for d, c in near for x in (c, d * d)])
        inner = sum((F.get(F.lit(t[0].tolist()), F.col(f"c{j}").cast("int")) for j, t in enumerate(table)), F.lit(0.0))
        probed = F.col("cell").isin([c for _, c in near])
        coded = self._codes().filter(probed).select("load", "row", "doc_id", (F.element_at(known, F.col("cell")) + F.col("bias") - 2 * inner).alias("about"))
        best = coded.orderBy("about", "doc_id").limit(candidates or CANDIDATES * k).select("load", "row")
        exact = self.vectors().filter(probed).join(F.broadcast(best), ["load", "row"]).select("doc_id", squared_l2("embedding", query).alias("distance"))
        return exact.orderBy("distance", "doc_id").limit(k)

    def nearest(self, query: list[float], k: int, *, nprobe: int = 4) -> tuple[DataFrame, dict[str, int]]:
        """Exactly the k nearest (doc_id, distance), and how many cells there are and were read."""
        if not self.loads:
            return self.vectors().select("doc_id", F.lit(0.0).alias("distance")).limit(0), {"cells": 0, "read": 0}
        cells, radius = self.cells_by_distance(query), self._radius()
        inside = lambda chosen: self.vectors().filter(F.col("cell").isin(chosen)).select("doc_id", squared_l2("embedding", query).alias("distance"))
        first = [c for _, c in cells[:nprobe]]
        got = inside(first).select("distance").orderBy("distance").limit(k).collect()
        limit = sqrt(got[-1]["distance"]) * (1 + 1e-9) if len(got) == k else float("inf")
        open_ = first + [c for d, c in cells[nprobe:] if d <= limit + radius[c] * (1 + 1e-9)]
        return inside(open_).orderBy("distance", "doc_id").limit(k), {"cells": len(cells), "read": len(open_)}

    def search_many(self, queries: DataFrame, k: int, *, nprobe: int = 8, candidates: int | None = None) -> DataFrame:
        """(query_id, doc_id, distance, rank) for all (query_id, embedding). Queries and codes meet in blocks, by cell."""
        out = self.vectors().select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "doc_id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
        if not self.loads:
            return out.limit(0)
        model, parts, size, most = self.model, self.state["parts"], self.state["size"], candidates or CANDIDATES * k
        known = np.array(sorted(self._radius()))
        asked = queries.filter(usable("embedding", self.state["size"])).select("query_id", F.col("embedding").cast("array<float>").alias("q"))
        kind = queries.schema["query_id"].dataType.simpleString()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in _slices(batch.num_rows, max(len(known), nprobe * size)):
                    some = batch.slice(s.start, s.stop - s.start)
                    gaps = _gaps(_matrix(some.column("q"), some.num_rows), model.centers[known])
                    near = np.argsort(gaps, axis=1, kind="stable")[:, :nprobe]
                    row = pa.array(np.repeat(np.arange(some.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([some.column("query_id").take(row), some.column("q").take(row), pa.array(known[near].reshape(-1).astype(np.int32)), pa.array(np.take_along_axis(gaps, near, 1).reshape(-1))], names=["query_id", "q", "cell", "gap"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                for c in np.unique(cell):
                    rows = batch.take(pa.array(np.flatnonzero(cell == c)))
                    for a in range(0, rows.num_rows, PACK):
                        some = rows.slice(a, PACK)
                        codes = np.stack([some.column(f"c{j}").to_numpy() for j in range(parts)], 1).astype(np.uint8)
                        yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int32()), "load": pa.array([some.column("load").to_pylist()], pa.list_(pa.string())), "rows": [some.column("row").to_numpy().tobytes()], "bias": [some.column("bias").to_numpy().tobytes()], "codes": [codes.tobytes()]})

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, q, gap = _listed(batch.column("asked"), i, "query_id", "q", "gap")
                    r = {c: batch.column(c)[i].as_py() for c in ("cell", "load", "rows", "bias", "codes")}
                    table = model.lookup(_matrix(q, len(q)))
                    codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, parts)
                    about = gap.to_numpy()[:, None] + np.frombuffer(r["bias"], float)[None, :] - 2 * sum(t[:, codes[:, j]] for j, t in enumerate(table))
                    best = np.argpartition(about, most - 1, axis=1)[:, :most] if about.shape[1] > most else np.broadcast_to(np.arange(about.shape[1]), about.shape)
                    rows, loads = np.frombuffer(r["rows"], np.int64)[best], np.array(r["load"], object)[best]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([r["cell"]] * len(ids), pa.int32()), pa.array(loads.tolist(), pa.list_(pa.string())), pa.array(rows.tolist(), pa.list_(pa.int64())), pa.array(np.take_along_axis(about, best, 1).tolist(), pa.list_(pa.float64()))], names=["query_id", "cell", "load", "row", "about"])

        def merge(found: pa.Table) -> pa.Table:
            """The best candidates of one query, of all packs: as many lists as cells are probed and packs are in them."""
            sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in found["row"].chunks])
            flat = {c: pa.chunked_array([x.flatten() for x in found[c].chunks]).combine_chunks() for c in ("load", "row", "about")}
            cell = np.repeat(found["cell"].to_numpy(), sizes)
            best = np.lexsort((flat["row"].to_numpy(), flat["about"].to_numpy()))[:most]
            return pa.table({"query_id": found["query_id"].take(pa.array(np.zeros(len(best), np.int64))), "load": flat["load"].take(pa.array(best)), "row": flat["row"].take(pa.array(best)), "cell": pa.array(cell[best], pa.int32())})

        blocks = max(1, ceil(asked.count() / BLOCK))
        probes = asked.mapInArrow(probe, f"query_id {kind}, q array<float>, cell int, gap double")
        grouped = probes.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "q", "gap")).alias("asked")).drop("block")
        packs = self._codes().mapInArrow(pack, "cell int, load array<string>, rows binary, bias binary, codes binary")
        met = grouped.join(packs, "cell").mapInArrow(meet, f"query_id {kind}, cell int, load array<string>, row array<long>, about array<double>")
        chosen = met.groupBy("query_id").applyInArrow(merge, f"query_id {kind}, load string, row long, cell int")
        found = chosen.join(self.vectors(), ["load", "row", "cell"]).join(asked, "query_id")
        distance = F.aggregate(F.zip_with("embedding", "q", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))
        with config.during(self.spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
            return stored(found.select("query_id", "doc_id", distance.alias("distance")).withColumn("rank", rank).filter(F.col("rank") <= k), "nearest")


def nearest_many(queries: DataFrame, vectors: DataFrame, k: int, *, size: int, parts: int = 32) -> DataFrame:
    """Exactly the k nearest (query_id, doc_id, distance, rank) of every query among all (doc_id, embedding).

    A stated set of queries against all rows: every block of queries goes to each of ``parts`` parts of the vectors and meets it
    in blocks; a part keeps each query's k best. Ids are numbers; vectors that cannot be indexed are left out.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (asks, q), (ids, x) = _listed(batch.column("asked"), i, "query_id", "v"), _listed(batch.column("held"), i, "doc_id", "v")
                q, x = _matrix(q, len(q)), _matrix(x, len(x))
                gaps = _gaps(q, x)
                # A few more than k, ranked by exact differences: the product form above is not exact to the last digit.
                best = np.argpartition(gaps, k + 7, axis=1)[:, : k + 8] if gaps.shape[1] > k + 8 else np.broadcast_to(np.arange(len(x)), gaps.shape)
                ids = ids.to_numpy()
                exact = ((q[:, None, :] - x[best]) ** 2).sum(2)
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(asks.to_numpy(), best.shape[1]), "doc_id": ids[best].reshape(-1), "distance": exact.reshape(-1)})

    good = vectors.filter(usable("embedding", size)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").alias("v"))
    asked = queries.filter(usable("embedding", size)).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("v"))
    n, m = good.count(), asked.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(parts, ceil(n / PACK)))).cast("int")
    held = good.groupBy(part.alias("part")).agg(F.collect_list(F.struct("doc_id", "v")).alias("held"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, ceil(m / BLOCK))))
    blocks = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    spread = blocks.select("asked", F.explode(F.sequence(F.lit(0), F.lit(max(parts, ceil(n / PACK)) - 1))).alias("part"))
    some = spread.join(held, "part").select("asked", "held").mapInArrow(meet, "query_id long, doc_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))
    with config.during(queries.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        return stored(some.withColumn("rank", rank).filter(F.col("rank") <= k), "nearest")
