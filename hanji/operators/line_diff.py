"""Line differences of two versions of a text: exact longest common subsequences, by joins and one pass a pair.

Equal lines of a pair's versions meet in an equi join on the line; each line of the old version brings the places that
it has in the new one, as one list, so that lines that repeat make no pairs. What remains is the longest run of places
that grows, which one pass over a pair's lines finds with a sorted list of ends. Pairs are dealt over tasks; a task
holds the line numbers of one pair.

Lines are what line feeds separate; an empty piece at the end is no line; null is a text without lines. Pairs have a key that is
unique; a pair without common lines, or without lines, has a row like others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(text: str) -> Column:
    """A text's lines as an array."""
    whole = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return F.when(F.element_at(whole, -1) == "", F.slice(whole, 1, F.size(whole) - 1)).otherwise(whole)


def longest(matches: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """The longest sequence of (i, j) that grows in both, given for each i in order its places j, ascending."""
    ends: list[int] = []
    last: list[tuple] = []
    for i, places in matches:
        for j in reversed(places):
            k = bisect_left(ends, j)
            node = (i, j, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    out, node = [], last[-1] if last else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def aligned(pairs: DataFrame, *, key: str = "key", old: str = "old", new: str = "new") -> DataFrame:
    """(key, i, j): the lines that both versions keep, by their numbers from 0."""
    kind = pairs.schema[key].dataType.simpleString()
    digest = lambda text: F.transform(lines(text), lambda x: F.unhex(F.sha2(x, 256)))
    before = pairs.select(F.col(key).alias("key"), F.posexplode(digest(old)).alias("i", "line"))
    after = pairs.select(F.col(key).alias("key"), F.posexplode(digest(new)).alias("j", "line")).groupBy("key", "line").agg(F.sort_array(F.collect_list("j")).alias("places"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest([(m["i"], m["places"]) for m in matches]) for matches in batch.column("matches").to_pylist()]
            row = pa.array([n for n, some in enumerate(found) for _ in some], pa.int32())
            places = [pa.array([x[side] for some in found for x in some], pa.int32()) for side in (0, 1)]
            yield pa.record_batch([batch.column("key").take(row), *places], ["key", "i", "j"])

    met = before.join(after, ["key", "line"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "places"))).alias("matches"))
    return met.mapInArrow(work, f"key {kind}, i int, j int")


def counts(pairs: DataFrame, *, key: str = "key", old: str = "old", new: str = "new") -> DataFrame:
    """(key, added, removed, total): how many lines each pair's change adds and removes, the fewest that do."""
    sizes = pairs.select(F.col(key).alias("key"), F.size(lines(old)).alias("a"), F.size(lines(new)).alias("b"))
    same = aligned(pairs, key=key, old=old, new=new).groupBy("key").agg(F.count("*").cast("int").alias("same"))
    both = sizes.join(same, "key", "left").withColumn("same", F.coalesce("same", F.lit(0)))
    return both.select("key", (F.col("b") - F.col("same")).alias("added"), (F.col("a") - F.col("same")).alias("removed"), (F.col("a") + F.col("b") - 2 * F.col("same")).alias("total"))


def changes(pairs: DataFrame, *, key: str = "key", old: str = "old", new: str = "new") -> DataFrame:
    """(key, place, sign, line): every line of both versions in the order of a unified text; sign is ``-``, ``+`` or a blank."""
    kept = aligned(pairs, key=key, old=old, new=new)
    before = pairs.select(F.col(key).alias("key"), F.posexplode(lines(old)).alias("i", "line")).join(kept, ["key", "i"], "left")
    after = pairs.select(F.col(key).alias("key"), F.posexplode(lines(new)).alias("j", "line")).join(kept.select("key", "j"), ["key", "j"], "left_anti")
    # Added lines stand before the next kept line; removed ones before the added ones of the same gap.
    ends = before.filter("j IS NOT NULL").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("j", "i"))).alias("kept"))
    gap = F.coalesce(F.size(F.filter("kept", lambda x: x["j"] < F.col("j"))), F.lit(0))
    left = F.coalesce(F.size(F.filter("kept", lambda x: x["i"] < F.col("i"))), F.lit(0))
    rows = before.join(ends, "key", "left").select("key", left.alias("gap"), F.when(F.col("j").isNull(), 0).otherwise(2).alias("rank"), F.col("i").alias("n"), F.when(F.col("j").isNull(), "-").otherwise(" ").alias("sign"), "line")
    rows = rows.unionByName(after.join(ends, "key", "left").select("key", gap.alias("gap"), F.lit(1).alias("rank"), F.col("j").alias("n"), F.lit("+").alias("sign"), "line"))
    return rows.select("key", F.struct("gap", "rank", "n").alias("place"), "sign", "line")


def html_table(changed: DataFrame) -> DataFrame:
    """(key, html): each pair's changes as a table with a row a line."""
    safe = F.replace(F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name = F.when(F.col("sign") == "-", "removed").when(F.col("sign") == "+", "added").otherwise("kept")
    row = F.concat(F.lit('<tr class="'), name, F.lit('"><td>'), F.col("sign"), F.lit("</td><td>"), safe, F.lit("</td></tr>"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("place", row.alias("row")))), lambda x: x["row"])
    return changed.groupBy("key").agg(F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))
