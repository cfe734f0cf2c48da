"""Clustering under bounds against scans of all centroids."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanji.llm import centroid_cluster as cc

SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(x, c, rounds):
    """Plain rounds: (clusters, squared distances, centroids)."""
    c = [list(map(int, v)) for v in c]
    for r in range(rounds + 1):
        d = [[sum((int(a) - b) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        own = [min(range(len(c)), key=lambda j, row=row: (row[j], j)) for row in d]
        if r == rounds:
            return own, [row[j] for row, j in zip(d, own, strict=True)], c
        for j in range(len(c)):
            mine = [v for v, o in zip(x, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(map(int, col)) // len(mine) for col in zip(*mine, strict=True)]


@pytest.mark.parametrize(("n", "size", "k", "spread", "seed"), [(300, 8, 16, 3, 0), (300, 2, 16, 2, 1), (200, 5, 9, 1 << 22, 2), (40, 64, 16, 60, 3), (150, 3, 2, 4, 4), (60, 4, 1, 5, 5)])
def test_bounds_give_what_scans_give(n, size, k, spread, seed):
    """Small grids make many ties; large numbers leave floating point's exact range."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (n, size))
    if seed == 0:
        x = x + rng.integers(0, 5, (n, 1)) * 20
    c = x[rng.permutation(n)[:k]].astype(np.int64)
    named = min(max(1, k // cc.NAMED), k - 1)
    state = cc.State(x.astype(np.int64), named)
    state.scan(np.arange(n), c)
    state.depth[:] = named + 1
    depths = []
    for _ in range(5):
        new = c.copy()
        for j in range(k):
            if (state.cluster == j).any():
                new[j] = [int(s) // int((state.cluster == j).sum()) for s in x[state.cluster == j].sum(0)]
        gap = (new - c).astype(object)
        state.name_fewer(named)
        state.widen(np.array([float(s) ** 0.5 * (1 + 2 * cc.SLACK) for s in (gap * gap).sum(1)]))
        c = new
        state.assign(c)
        depths.append(state.depth.copy())
        d = cc.squares(x.astype(np.int64), c)
        assert (state.cluster == d.argmin(1)).all()
        exact = np.sqrt(d.astype(float))
        rows = np.arange(n)
        assert (state.upper >= exact[rows, state.cluster] * (1 - 1e-15)).all()
        for z in range(named):
            assert (state.low[:, z] <= exact[rows, state.near[:, z]] * (1 + 1e-15)).all()
        for i in rows:
            rest = np.delete(exact[i], [state.cluster[i], *state.near[i]])
            assert not len(rest) or state.low[i, named] <= rest.min() * (1 + 1e-15)
            assert len({int(state.cluster[i]), *map(int, state.near[i])}) == named + 1
        named = min(named, max(k // cc.LEAST_NAMED, min(int(state.depth.max()), named)))
    if seed == 0:
        assert (depths[-1] == 0).mean() > 0.5  # most vectors are certified without a distance to any other centroid


def brute(rows):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    if not kept:
        return []
    own, d, c = lloyd([v for _, v in kept], [v for _, v in kept[:16]], 3)
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((kept[n][0], j, d[n], sum(e for e, o in zip(d, own, strict=True) if o == j), sum(d), sha[j]) for n, j in enumerate(own)), key=str)


def test_query_equals_brute_force_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(9)
    vec = lambda: [float(x) for x in rng.normal(0, 1, 64).astype(np.float32)]
    same = vec()
    rows = [(i, vec()) for i in range(60)] + [(i, same) for i in range(100, 140)] + [(7, same), (7, same), (None, vec()), (None, vec())]
    rows += [(200, None), (201, []), (202, vec()[:63]), (203, [*vec()[:63], None]), (204, [*vec()[:63], float("nan")]), (205, [*vec()[:63], float("inf")]), (206, [0.0] * 64)]
    odd = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "v", "cluster", "distance", "near")})
    for name, part, want in (("all", odd, rows), ("few", odd.filter("vec_id < 5"), rows[:5]), ("none", odd.limit(0), [])):
        part.repartition(3).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = cc.op11_centroid_cluster(spark, f"{tmp_path}/{name}").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(want)


def test_components_beyond_exact_distances_are_refused(spark):
    far = spark.createDataFrame([(1, [3e7] * 64, 0)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        cc.quantized(far).collect()


def test_rounds_skip_distances_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    at = rng.normal(0, 4, (16, 64))
    rows = [(i, [float(x) for x in at[i % 16] + rng.normal(0, 0.1, 64)], 0) for i in range(1600)]
    state, _ = cc.cluster(cc.quantized(spark.createDataFrame(rows, SCHEMA)))
    assert state.filter("depth = 0").count() > 1200
