"""Connected components of a graph that is too large for one task, by contraction towards smaller ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanji.llm.common import keep

#: Edges that one task reduces together; bounds its memory.
CHUNK = 500_000


def spanning(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of which each chunk of a partition keeps only a spanning forest, tied to the smallest id it saw."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(v: int) -> int:
            top = v
            while (up := root.get(top, top)) != top:
                top = up
            while v != top:
                root[v], v = top, root.get(v, v)
            return top

        def flush() -> pa.RecordBatch:
            pairs = [(find(v), v) for v in list(root)]
            pairs = [p for p in pairs if p[0] != p[1]]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                low, high = min(x, y), max(x, y)
                root[high] = root[low] = low
            if len(root) > CHUNK:
                yield flush()
        if root:
            yield flush()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(work, "a long, b long")


def components(edges: DataFrame, *, limit: int = 60) -> DataFrame:
    """(id, comp): for each id on an edge the smallest id that it reaches.

    Each round points every node at its smallest neighbour (or itself), follows the pointers twice, and contracts. The
    smallest id of a component always points at itself, so it is what remains. Rows shrink from round to round, and
    the rounds are few; each is written to the shared folder.
    """
    left = keep(spanning(edges.filter("a <> b")))
    steps: list[DataFrame] = []
    for _ in range(limit):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("other")))
        parent = keep(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("up")))
        for _ in range(2):
            above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up").select("id", F.col("top").alias("up"))
        parent = keep(parent)
        steps.append(parent)
        moved = left.join(parent.select(F.col("id").alias("a"), F.col("up").alias("na")), "a").join(parent.select(F.col("id").alias("b"), F.col("up").alias("nb")), "b")
        left = keep(spanning(moved.filter("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()))
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return edges.sparkSession.createDataFrame([], "id long, comp long")
    found = steps[0].select("id", F.col("up").alias("comp"))
    for step in steps[1:]:
        nxt = step.select(F.col("id").alias("comp"), F.col("up").alias("next"))
        found = found.join(nxt, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))
    return keep(found)
