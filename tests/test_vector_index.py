"""The partitioned vector index against scans of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanji.operators import vector_index as vi
from hanji.sources.versions import own_folder

SCHEMA = "doc_id long, embedding array<float>"
rng = np.random.default_rng(11)
CENTERS = rng.normal(0, 3, (30, 16))
X = (CENTERS[rng.integers(0, 30, 1500)] + rng.normal(0, 0.6, (1500, 16))).astype(np.float32)


def rows(ids):
    return [(int(i), [float(v) for v in X[i]]) for i in ids]


def brute(ids, q, k):
    d = ((X[ids].astype(float) - np.asarray(q, float)) ** 2).sum(1)
    order = np.lexsort((ids, d))[:k]
    return [int(ids[j]) for j in order]


@pytest.fixture(scope="module")
def built(spark):
    odd = [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [float("inf")] * 16)]
    return vi.VectorIndex(spark, own_folder(spark, "vec")).build(spark.createDataFrame(rows(range(1500)) + odd, SCHEMA).repartition(3), cells=30)


def test_exact_search_reads_few_cells_and_misses_nothing(built):
    read = 0
    for q in range(0, 1500, 300):
        got, seen = built.nearest([float(v) for v in X[q]], 10)
        assert [r["doc_id"] for r in got.collect()] == brute(np.arange(1500), X[q], 10)
        read += seen["read"] / seen["cells"]
    assert read / 5 < 0.6
    assert [r["doc_id"] for r in built.nearest([50.0] * 16, 3)[0].collect()] == brute(np.arange(1500), [50.0] * 16, 3)


def test_approximate_search_prunes_partitions_and_recalls(built, spark):
    hits = 0
    for q in range(0, 1500, 150):
        near = [c for _, c in built.cells_by_distance(X[q].tolist())[:3]]
        found = built.search([float(v) for v in X[q]], 10, nprobe=3)
        hits += len({r["doc_id"] for r in found.collect()} & set(brute(np.arange(1500), X[q], 10)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters") >= 2 and all(f"{c}" in plan.partition("PartitionFilters")[2] for c in near)
    assert hits >= 90
    codes = built._codes().filter(F.col("cell").isin(near))
    assert {r["c"] for r in codes.select(F.regexp_extract("_metadata.file_path", "cell=(\\d+)", 1).cast("int").alias("c")).distinct().collect()} <= set(near)


def test_probes_suit_the_data(built):
    few, most = built.probes_for(0.5), built.probes_for(0.99)
    assert 1 <= few <= most <= 10


def test_many_queries_equal_single_ones_and_recall(built, spark):
    asked = spark.createDataFrame(rows(range(0, 1500, 20)), "query_id long, embedding array<float>")
    got = {}
    for r in built.search_many(asked, 10, nprobe=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    exact = {}
    for r in vi.nearest_many(asked, spark.createDataFrame(rows(range(1500)), SCHEMA), 10, size=16, parts=3).collect():
        exact.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    assert {q: [v[i + 1] for i in range(10)] for q, v in exact.items()} == {q: brute(np.arange(1500), X[q], 10) for q in range(0, 1500, 20)}
    assert sum(len(set(got[q].values()) & set(exact[q].values())) for q in exact) >= 0.93 * 10 * len(exact)
    one = [r["doc_id"] for r in built.search([float(v) for v in X[40]], 10, nprobe=4).collect()]
    assert [got[40][i + 1] for i in range(10)] == one


def test_loads_deletions_and_rebuilding(spark):
    ix = vi.VectorIndex(spark, own_folder(spark, "vec"))
    assert ix.nearest([0.0] * 16, 3)[0].count() == ix.search([0.0] * 16, 3).count() == 0
    ix = ix.build(spark.createDataFrame(rows(range(300)), SCHEMA), cells=10)
    ix = ix.add(spark.createDataFrame(rows(range(300, 1000)) + rows([7, 7]), SCHEMA))
    assert not ix.is_outgrown()
    ix = ix.add(spark.createDataFrame(rows(range(1000, 1500)), SCHEMA)).delete(spark.createDataFrame([(i,) for i in [*range(50, 120), 7, 1450, 9999, None]], "doc_id long"))
    assert ix.is_outgrown()
    left = np.array([i for i in range(1500) if not (50 <= i < 120 or i in (7, 1450))])
    for state in (ix, ix.rebuild()):
        assert state.vectors().count() == len(left)
        for q in (60, 7, 1450, 400):
            assert [r["doc_id"] for r in state.nearest([float(v) for v in X[q]], 8)[0].collect()] == brute(left, X[q], 8)
    assert not state.is_outgrown() and state.delete(state.vectors().select("doc_id")).loads == {}


def test_equal_vectors_few_vectors_and_none(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(1000, [9.0, 9.0, 9.0])]
    ix = vi.VectorIndex(spark, own_folder(spark, "vec")).build(spark.createDataFrame(same, SCHEMA))
    assert [r["doc_id"] for r in ix.nearest([1.0, 2.0, 3.0], 4)[0].collect()] == [0, 1, 2, 3]
    assert [r["doc_id"] for r in ix.search([9.0, 9.0, 8.0], 1).collect()] == [1000]
    empty = vi.VectorIndex(spark, own_folder(spark, "vec")).build(spark.createDataFrame([(1, None)], SCHEMA))
    assert empty.loads == {} and empty.nearest([1.0], 2)[0].count() == 0
    one = vi.VectorIndex(spark, own_folder(spark, "vec")).build(spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA))
    assert [r["distance"] for r in one.search([0.0, 0.0], 2).collect()] == [1.0]


def test_matrices_of_a_task_are_bounded(monkeypatch):
    """Many rows meet many centres in slices, whose matrices do not grow with either; the closest stay the same."""
    rng, seen, whole = np.random.default_rng(2), [], vi._gaps
    monkeypatch.setattr(vi, "_gaps", lambda x, c: seen.append(len(x) * len(c)) or whole(x, c))
    x, c = rng.normal(size=(9000, 16)), rng.normal(size=(900, 16))
    cell, *_ = vi.Model(c, [c[:50, :8], c[:50, 8:]]).encode(x)
    assert max(seen) <= vi.CELLS and (cell == whole(x, c).argmin(1)).all()
