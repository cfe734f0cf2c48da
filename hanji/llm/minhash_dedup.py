"""Near-duplicate groups by a MinHash LSH forest (operator 6).

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents with equal sets form one class; only
one representative of each class goes on. Its signature of :data:`COORDINATES` minima is read in :data:`TREES` orders,
each starting at another coordinate; a tree is the sorted order of all signatures so read. Representatives that share
their first :data:`DEPTH` coordinates in a tree are one region. A region of few representatives gives all its pairs as
candidates. In a region with more, each representative goes as deep as its own neighbourhood is dense: its candidates
are those next to it in the sorted order, with which it shares the longest prefixes. Candidates whose
signatures agree enough are confirmed on full sets, at most one per representative first (its best), then each crowded
region's representatives against centres of the region, then those candidates that would still join different groups.

What crowded regions then still hold of different groups is settled exactly. A shingle is rare if at most :data:`REGION`
of these representatives hold it: those that share a rare shingle are compared. Two that share none have at most their
other shingles in common, which rules most of them out by two numbers each; the pairs that are left are compared by
signature, in blocks. So every pair that shares a region has been compared, or ruled out by a bound, unless its two sides
are already in one group. Groups are connected components.

Sets are never gathered by group: a candidate's two sets meet in a join on ids, so that a hot group is dealt by its
members. A Bloom filter of bounded size keeps texts that no candidate needs out of that join.

Defined cases: null text has an empty set; empty sets are linked with nothing; fewer than five words give their whole
sequence as one shingle; of rows that share a doc_id each has the set of its own text, and all of them are in one group,
whatever their order; every row is returned; a null id is its own group; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanji.llm.common import keep, release, settle, text_batches
from hanji.llm.components import components

WORDS, THRESHOLD = 5, 75
COORDINATES, TREES, DEPTH = 60, 20, 3
#: Representatives of a region that are compared with one another.
REGION = 24
#: In a region with more, each representative meets so many on either side of it in the sorted order.
NEIGHBOURS = 2
#: Centres of a crowded region: representatives whose signatures agree most with the others', one of each share of ids.
CENTRES = 2
#: Representatives on either side of a block in which a crowded region's remaining pairs are compared.
BLOCK = 512
#: Share of equal coordinates below which no pair of similarity 0.75 is expected (more than four deviations).
LEAST_AGREEMENT = 0.5
PIECE_BYTES = 400_000
BLOOM_BITS_PER_ID, BLOOM_MOST_BITS = 16, 1 << 29

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.diff((~_SPACE[data]).view(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(r) + 1 for r in raw])
    up, down = _powers(1 << int(len(data) + 1).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    words = _mix((sums[last] - sums[first]) * down[first])
    stops = np.searchsorted(first, ends)
    starts = np.concatenate(([0], stops[:-1]))
    runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs += words[k : k + len(runs)] * np.uint64(pow(_STEP, k, 1 << 64))
    runs = _mix(runs)
    out = []
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            whole = sum(int(w) * pow(_STEP, k, 1 << 64) for k, w in enumerate(words[a:b])) + (b - a) * 0xA0761D6478BD642F
            out.append(_mix(np.array([whole & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, coordinates) 32-bit minima; all ones for empty sets."""
    out = np.full((len(sets), COORDINATES), 0xFFFFFFFF, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        values = np.concatenate([sets[i] for i in some])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in some])[:-1]))
        for k, (a, b) in enumerate(zip(*_permutations(), strict=True)):
            out[some, k] = np.minimum.reduceat((values * a + b) >> np.uint64(32), starts)
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= PIECE_BYTES:
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), set_key (hash of the set), sig (signature); one pass over the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes, keys, sigs = [], [], []
            for _, piece in _pieces(texts):
                sets = shingle_sets(piece)
                sizes += [len(s) for s in sets]
                keys += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sigs += [s.tobytes() for s in signatures(sets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n", "set_key", "sig"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n long, set_key binary, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _prefix_key(sig: np.ndarray, tree: int, depth: int) -> np.ndarray:
    start, key = tree * COORDINATES // TREES, np.full(len(sig), tree * 1000 + depth, np.uint64)
    for k in range(depth):
        key = _mix(key ^ sig[:, (start + k) % COORDINATES].astype(np.uint64)) + np.uint64(k)
    return key.view(np.int64)


def tree_entries(reps: DataFrame) -> DataFrame:
    """(key, tree, rep, n): each representative's region at :data:`DEPTH` in each tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, m = _matrix(batch.column("sig")), len(batch)
            keys = np.concatenate([_prefix_key(sig, t, DEPTH) for t in range(TREES)])
            ids = [np.tile(batch.column(c).to_numpy(), TREES) for c in ("rep", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.arange(TREES, dtype=np.int32), m)), pa.array(ids[0]), pa.array(ids[1])], names=["key", "tree", "rep", "n"])

    return reps.select("rep", "n", "sig").mapInArrow(work, "key long, tree int, rep long, n long")


def region_pairs(entries: DataFrame) -> DataFrame:
    """(a, b) of entries with the same key, where set sizes allow the similarity. Keys have few entries each."""
    grouped = entries.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("rep", "n"))).alias("members")).filter("size(members) > 1")
    once = grouped.select("members").distinct()
    one = once.select("members", F.posexplode("members").alias("i", "x"))
    two = one.select("x", F.explode(F.expr("slice(members, i + 2, greatest(size(members) - i - 1, 0))")).alias("y"))
    sized = two.filter("100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)")
    return sized.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def prefix_neighbours(hot: DataFrame) -> DataFrame:
    """(a, b): next to one another in a tree's sorted order, within its too large regions.

    The order is dealt by ranges over all trees, so that a large region spans many tasks. Each task pairs the rows it
    passes; the last rows of one task and the first of the next meet in a second pass, dealt by the border between them.
    """

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, trees = _matrix(batch.column("sig")), batch.column("trees").to_pylist()
            rows = [(bytes([t]) + np.roll(sig[i], -(t * COORDINATES // TREES)).astype(">u4").tobytes(), i) for i, ts in enumerate(trees) for t in ts]
            at = np.array([i for _, i in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in rows], pa.binary()), pa.array(batch.column("rep").to_numpy()[at]), pa.array(batch.column("n").to_numpy()[at])], names=["ord", "rep", "n"]
            )

    shared = 1 + 4 * DEPTH

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tail = [], []
        for batch in batches:
            out = []
            for row in zip(batch.column("ord").to_pylist(), batch.column("rep").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for near in tail:
                    if near[1] != row[1] and near[0][:shared] == row[0][:shared] and 100 * min(near[2], row[2]) >= THRESHOLD * max(near[2], row[2]):
                        out.append((min(near[1], row[1]), max(near[1], row[1]), None, None))
                if len(head) < NEIGHBOURS:
                    head.append(row)
                tail = [*tail, row][-NEIGHBOURS:]
            yield made(out)
        here = TaskContext.get().partitionId()
        yield made([(r[1], r[2], r[0], border) for border, rows in ((here, head), (here + 1, tail)) for r in rows])

    def made(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], names=["a", "b", "ord", "border"])

    schema = "a long, b long, ord binary, border int"
    ordered = hot.mapInArrow(order, "ord binary, rep long, n long")
    ranged = ordered.repartitionByRange("ord", "rep").sortWithinPartitions("ord", "rep")
    found = keep(ranged.mapInArrow(pair, schema))
    edges = found.filter("ord IS NOT NULL").select("border", "ord", F.col("a").alias("rep"), F.col("b").alias("n"))
    across = edges.repartition("border").sortWithinPartitions("border", "ord", "rep").mapInArrow(pair, schema)
    return found.unionByName(across).filter("ord IS NULL").select("a", "b")


def regions(reps: DataFrame) -> DataFrame:
    """(key, tree, rep, n, count): representatives that share their region with others."""
    entries = tree_entries(reps.filter("n > 0"))
    return keep(entries.join(entries.groupBy("key").count().filter("count > 1"), "key"))


def candidates(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, from all trees."""
    pairs = region_pairs(shared.filter(F.col("count") <= REGION))
    crowded = shared.filter(F.col("count") > REGION)
    if not crowded.isEmpty():
        trees = crowded.groupBy("rep").agg(F.collect_set("tree").alias("trees"))
        pairs = pairs.unionByName(prefix_neighbours(trees.join(reps.select("rep", "n", "sig"), "rep").select("rep", "n", "sig", "trees")))
    return pairs.distinct()


def mixed_regions(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, tree, rep, n, comp): the regions with more than :data:`REGION` that hold more than one group."""
    crowded = shared.filter(F.col("count") > REGION).join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("key", "tree", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    several = crowded.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    return keep(crowded.join(several, "key"))


def centre_pairs(mixed: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): the centres of each region and its representatives of other groups.

    A text that many others vary has the minima that most of them have, though they may differ too much from one
    another. Its links leave few groups; :func:`rare_shingles` and :func:`block_pairs` find what a wrong choice misses.
    """

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("sig")).astype(np.int64) | np.arange(COORDINATES, dtype=np.int64) << 32
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), COORDINATES)), pa.array(values.ravel())], names=["rep", "value"])

    own = keep(mixed.select("rep").distinct().join(reps.select("rep", "sig"), "rep").select("rep", "sig").mapInArrow(minima, "rep long, value long"))
    often = own.groupBy("value").agg(F.count("*").alias("times")).filter("times > 1")
    scores = own.join(often, "value").groupBy("rep").agg(F.sum("times").alias("score"))
    scored = mixed.join(scores, "rep").groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(CENTRES)).alias("share"))
    best = scored.agg(F.max(F.struct("score", (-F.col("rep")).alias("rep"), "n", "comp")).alias("c"))
    centres = best.select("key", (-F.col("c.rep")).alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.comp").alias("centre_comp"))
    met = mixed.join(centres, "key").filter("comp <> centre_comp AND 100 * least(n, centre_n) >= 75 * greatest(n, centre_n)")
    return met.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()


def rare_shingles(mixed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the representatives in ``mixed`` that share a rare shingle; (rep, most): how many others each has.

    Each rare shingle gives few pairs, and each frequent one none, so the work grows with the sets, not with the crowds.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                sets = [np.frombuffer(v, np.int64) for v in part.column("values").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("rep").to_numpy(), [len(v) for v in sets])), pa.array(np.concatenate(sets))], names=["rep", "shingle"])

    ids = mixed.select("rep").distinct()
    held = full_sets(docs, ids.select(F.col("rep").alias("id"))).hint("merge").join(ids, "rep").mapInArrow(work, "rep long, shingle long").distinct()
    held = keep(held)
    counts = held.groupBy("shingle").agg(F.count("*").alias("times")).filter(F.col("times") <= REGION)
    rare = keep(held.join(counts, "shingle"))
    most = held.groupBy("rep").agg(F.count("*").alias("all")).join(rare.groupBy("rep").agg(F.count("*").alias("rare")), "rep", "left")
    several = rare.filter("times > 1")
    left, right = several.select("shingle", F.col("rep").alias("a")), several.select("shingle", F.col("rep").alias("b"))
    return left.join(right, "shingle").filter("a < b").select("a", "b").distinct(), most.select("rep", (F.col("all") - F.coalesce("rare", F.lit(0))).alias("most"))


def possible(pairs: DataFrame, reps: DataFrame, most: DataFrame) -> DataFrame:
    """The pairs without those that can only be similar if they share a rare shingle: sharing one, they are given by it."""
    sized = reps.select("rep", "n").join(most, "rep")
    a, b = (sized.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("most").alias(f"most_{c}")) for c in ("a", "b"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.filter(f"n_a IS NULL OR n_b IS NULL OR {100 + THRESHOLD} * least(most_a, most_b) >= {THRESHOLD} * (n_a + n_b)").select("a", "b")


def block_pairs(mixed: DataFrame, reps: DataFrame, most: DataFrame) -> DataFrame:
    """(a, b): all pairs of different groups in a region that can be similar by sizes, signatures and shingles not rare.

    All of a region is met by what is outside of its largest group. Both sides are dealt in blocks of about
    :data:`BLOCK`, each pair of blocks a group of its own. A pair is given by the first tree in which it shares a region.
    Similar sets of x and y shingles share at least 3/7 (x + y) at 75 %.
    """

    def work(block: pa.Table) -> pa.Table:
        met = block.column("met").to_numpy()
        cols = {c: block.column(c).to_numpy() for c in ("rep", "n", "comp", "outer", "most")}
        sig, tree = _matrix(block.column("sig")), block.column("tree")[0].as_py()
        own, others = np.flatnonzero(~met), np.flatnonzero(met)
        left, right = [], []
        for at in range(0, len(own), 64):
            x, y = own[at : at + 64, None], others[None]
            n, most = ([cols[c][v] for v in (x, y)] for c in ("n", "most"))
            open_ = (cols["comp"][x] != cols["comp"][y]) & (100 * np.minimum(*n) >= THRESHOLD * np.maximum(*n)) & ~(cols["outer"][x] & (cols["rep"][x] > cols["rep"][y]))
            open_ &= (100 + THRESHOLD) * np.minimum(*most) >= THRESHOLD * (n[0] + n[1])
            i, j = np.nonzero(open_)
            i, j = own[at + i], others[j]
            same = sig[i] == sig[j]
            enough = same.mean(1) >= LEAST_AGREEMENT
            for t in range(tree):
                enough &= ~same[:, (t * COORDINATES // TREES + np.arange(DEPTH)) % COORDINATES].all(1)
            left.append(cols["rep"][i[enough]])
            right.append(cols["rep"][j[enough]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (left, right))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    # What shares too few frequent shingles with anything of the region's smallest size needs no comparison.
    least = mixed.groupBy("key").agg(F.min("n").alias("least"))
    able = mixed.join(most, "rep").join(least, "key").filter(f"{100 + THRESHOLD} * most >= {THRESHOLD} * (n + greatest(least, n * {THRESHOLD / 100}))").drop("least")
    able = keep(able)
    groups = able.groupBy("key", "comp").agg(F.count("*").alias("here"))
    largest = groups.groupBy("key").agg(F.max(F.struct("here", "comp")).alias("m"), F.sum("here").alias("all")).filter(F.col("m.here") < F.col("all"))
    blocks = largest.select("key", F.col("m.comp").alias("main"), F.ceil(F.col("all") / BLOCK).alias("rows"), F.ceil((F.col("all") - F.col("m.here")) / BLOCK).alias("cols"))
    sided = keep(able.join(blocks, "key").withColumn("outer", F.col("comp") != F.col("main"))).join(reps.select("rep", "sig"), "rep")
    base = ("key", "tree", "rep", "n", "comp", "outer", "most", "sig")
    row, col = F.pmod(F.xxhash64("rep"), F.col("rows")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cols"))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    own = sided.select(*base, F.lit(False).alias("met"), row.alias("row"), every("cols").alias("col"))
    others = sided.filter("outer").select(*base, F.lit(True).alias("met"), every("rows").alias("row"), col.alias("col"))
    return own.unionByName(others).groupBy("key", "row", "col").applyInArrow(work, "a long, b long").distinct()


def agreeing(pairs: DataFrame, reps: DataFrame, least: float = LEAST_AGREEMENT) -> DataFrame:
    """(a, b, agree): candidates whose signatures agree in at least ``least`` of the coordinates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            agree = (_matrix(batch.column("sa")) == _matrix(batch.column("sb"))).mean(1)
            at = pa.array(np.flatnonzero(agree >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(agree[agree >= least])], names=["a", "b", "agree"])

    left = pairs.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
    both = left.join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long, agree double")


def bloom(ids: DataFrame) -> np.ndarray:
    """Bits that the hashes of the ids set; a power of two of them, bounded whatever the number of ids."""
    n = max(1, ids.count())
    bits = min(BLOOM_MOST_BITS, 1 << max(16, (BLOOM_BITS_PER_ID * n - 1).bit_length()))
    places = ids.select(F.explode(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1)))).alias("h")).select(F.pmod("h", F.lit(bits)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("v"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint64(bits) | h >> np.uint64(64 - bits)


def _ended(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
    return h ^ h >> np.uint64(32)


def hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``xxhash64(id)`` and ``xxhash64(id, 1)`` of 64-bit ids, as Spark computes them; the constants are the hash's own."""
    one, two, three, four, five = (np.uint64(c) for c in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    first = _turned(ids.view(np.uint64) * two, 31) * one ^ np.uint64(42 + 8) + five
    first = _ended(_turned(first, 27) * one + four)
    second = _ended(_turned(first + five + np.uint64(4) ^ one, 23) * two + three)
    return first.view(np.int64), second.view(np.int64)


def may_hold(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ids may be among those that made the table of :func:`bloom`."""
    hit = np.ones(len(ids), bool)
    for h in hashes(ids):
        p = h & np.int64(len(table) * 64 - 1)
        hit &= (table[p >> 6] >> (p & 63)) & 1 == 1
    return hit


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, values): the sets of the rows whose id may be among ``ids``.

    Join with it by the hint ``merge``: those that pass are few, and if the other side were broadcast to them, a task that
    goes on in Python would hold two workers, which executors then keep.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bloom(ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(may_hold(bits.value, batch.column("doc_id").to_numpy()))
            rows = batch.take(pa.array(at))
            texts = [t or "" for t in rows.column("text").to_pylist()]
            for i, piece in _pieces(texts):
                sets = shingle_sets(piece)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(i, len(piece)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "values"])
        release()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return named.mapInArrow(work, "rep long, values binary")


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of the pairs that are similar on full sets."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = full_sets(docs, ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                for x, y in zip(part.column("va").to_pylist(), part.column("vb").to_pylist(), strict=True):
                    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    ok.append(100 * both >= threshold * (len(u) + len(v) - both) and both > 0)
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])
        release()

    left = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("values").alias("va")).hint("merge"), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("values").alias("vb")).hint("merge"), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(work, "a long, b long").distinct()


def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose sides are in different groups."""
    a_comp, b_comp = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(a_comp, "a", "left").join(b_comp, "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Confirmed (a, b) that connect every group of representatives that pairs sharing a region connect."""
    shared = regions(reps)
    near = keep(agreeing(candidates(shared, reps), reps))
    ends = near.select(F.col("a").alias("v"), F.col("b").alias("w"), "agree").unionByName(near.select(F.col("b").alias("v"), F.col("a").alias("w"), "agree"))
    best = ends.groupBy("v").agg(F.max(F.struct("agree", (-F.col("w")).alias("w"))).alias("x")).select("v", (-F.col("x.w")).alias("w"))
    first = keep(confirmed(best.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct(), docs))
    comps = components(first)
    mixed = mixed_regions(shared, comps)
    if not mixed.isEmpty():
        centred = keep(across(agreeing(centre_pairs(mixed, reps), reps), comps))
        first = first if centred.isEmpty() else keep(first.unionByName(confirmed(centred, docs)))
        comps = components(first)
        mixed = mixed_regions(shared, comps)
    open_ = across(near, comps)
    if not mixed.isEmpty():
        rare, most = rare_shingles(mixed, docs)
        open_ = possible(open_, reps, most).unionByName(agreeing(across(rare, comps), reps).select("a", "b")).unionByName(block_pairs(mixed, reps, most))
    open_ = keep(open_.distinct())
    return first if open_.isEmpty() else keep(first.unionByName(confirmed(open_, docs)))


def _grouped(docs: DataFrame) -> DataFrame:
    """:func:`near_duplicates` where no id has two texts."""
    sketched = settle(sketch(docs))
    classes = keep(sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    reps = keep(classes.join(sketched.select(F.col("doc_id").alias("rep"), F.col("set_key").alias("k"), "n", "sig"), "rep").filter("set_key = k").select("rep", "n", "sig").dropDuplicates(["rep"]))
    comps = components(links(docs, reps))
    of_class = classes.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("set_key", F.coalesce("comp", "rep").alias("comp"))
    found = sketched.select("doc_id", "n", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _ids_of_texts(docs: DataFrame) -> DataFrame | None:
    """(doc_id, h, id): an id of its own for each text of the doc_ids that have several; null where there are none."""
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    several = keep(rows.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("doc_id"))
    if several.isEmpty():
        return None
    span = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    # Numbers that no document has: above all ids, or below where they reach too far up.
    base = span["high"] + 1 if span["high"] < 1 << 62 else span["low"] - (1 << 61)
    return keep(rows.join(several, "doc_id", "left_semi").distinct().withColumn("id", F.lit(base) + F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = _ids_of_texts(docs)
    if own is None:
        return _grouped(docs)
    # Texts are documents first; then the groups that meet in an id are one, named by the smallest of their ids.
    keyed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = settle(_grouped(keyed.join(own, ["doc_id", "h"], "left").select(F.coalesce("id", "doc_id").alias("doc_id"), "text")))
    true = own.select(F.col("id").alias("text_id"), F.col("doc_id").alias("true_id"))
    rows = found.join(true, F.col("doc_id") == F.col("text_id"), "left").select(F.coalesce("true_id", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("comp"), "text_id")
    met = rows.filter("text_id IS NOT NULL").select("doc_id", "comp").distinct()
    hubs = met.groupBy("doc_id").agg(F.min("comp").alias("a"))
    joined = components(met.join(hubs, "doc_id").select("a", F.col("comp").alias("b")))
    rows = settle(rows.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("whole")), "comp", "left").select("doc_id", "n_shingles", F.coalesce("whole", "comp").alias("comp")))
    names = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = rows.join(names, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)
  UNION ALL
  SELECT doc_id, ' ' || array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4
), sizes AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id
), linked AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
  ) p JOIN sizes u ON u.doc_id = p.a JOIN sizes v ON v.doc_id = p.b
  WHERE 100 * p.both >= 75 * (u.n + v.n - p.both)
), edges AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
