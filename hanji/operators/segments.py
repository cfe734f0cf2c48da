"""A text index in immutable segments: positional postings in blocks, tombstones, compaction, block-max top-k, phrases.

A segment holds some documents' tokens and their postings. It is partitioned by document: each task numbers its documents
in the order of their length, and makes blocks of what a term has in a window of them, which it writes sorted by term,
so that nothing is shuffled and a query's terms prune the pages of each file. A block knows the highest frequency and the
least length in it: from these follows a bound on every score there, whatever the collection's statistics are when it
is asked. Positions are a column of their own, which only phrases read.

Nothing written is changed. Adding writes a segment; deleting writes tombstones and how much the deleted documents count
in each term; both become visible with one version (:mod:`hanji.sources.versions`). Statistics are sums over segments less
what is deleted, so that scores equal those of an index built anew, at any time. Compaction rewrites segments that are
small or full of deleted documents from the tokens they hold, without the texts.

Repeated ids in one call are documents of their own, and all of them go when their id is deleted or added again; null ids
are never deleted; null and empty texts are documents without tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hanji import config
from hanji.functions.text import tokenize
from hanji.operators.boolean import BooleanQuery
from hanji.operators.index import idf, weight
from hanji.sources.versions import Versions, stored

#: Documents and, about, tokens of a window at most; rows that leave a task at once.
WINDOW_DOCS, WINDOW_TOKENS, ROWS = 1024, 200_000, 20_000
#: Bytes of tokens that a task gets at once: they are held several times over, in the JVM and in the worker.
BATCH_BYTES = 4 << 20
#: Bytes of a row group of postings: a writer holds one, and a query reads those that have its terms.
ROW_GROUP = 16 << 20
#: Bytes of files that a task reads to write a segment: what it makes of them is sorted without spilling.
SPLIT = 32 << 20
#: How tables are written: tokens and positions take half of what they do with the session's codec, and pages of few
#: blocks are left out one by one where a query's terms are not.
STORED = {"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.row.count.limit": 4000}
#: Windows that set the threshold of a top-k search.
SEED_WINDOWS = 8
#: Windows up to which their numbers are pushed into the scan; more are joined.
PUSHED_WINDOWS = 2000
#: Ids and tombstones up to which they are broadcast to the documents, so that no tokens are shuffled to them; more are joined.
BROADCAST = 1_000_000
#: Relative error of bounds, which are sums in another order than scores.
SLACK = 1 + 1e-9
#: Compaction takes segments with fewer documents than this share of all, or fewer living than this share of their own.
SMALL, LIVING = 0.1, 0.5


BLOCKS = "term string, window long, n long, max_tf int, min_dl long, ords array<long>, dls array<long>, tfs array<int>, positions array<array<int>>"


def _lists(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    """Lists that begin at ``first`` and end where the next one begins."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)).astype(np.int32)), values)


def _window(docs: pa.Table) -> pa.Table:
    """The blocks of a window: its documents' tokens by term, each term's documents in order with all places."""
    ords, dls = docs["ord"].to_numpy(), docs["dl"].to_numpy()
    tokens = pa.chunked_array([c.flatten() for c in docs["tokens"].chunks], pa.string()).combine_chunks()
    lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in docs["tokens"].chunks])
    begin = np.cumsum(lengths) - lengths
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy()
    place = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(len(ords)), lengths)[place]
    code = code[place]
    one = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    tf = np.diff(np.append(one, len(code)))
    at = place - begin[owner]
    owner, code = owner[one], code[one]
    block = np.flatnonzero(np.diff(code, prepend=-1))
    columns = [
        coded.dictionary.take(pa.array(code[block])), pa.array(np.full(len(block), ords[0])), pa.array(np.diff(np.append(block, len(code)))),
        pa.array(np.maximum.reduceat(tf, block).astype(np.int32)), pa.array(np.minimum.reduceat(dls[owner], block)),
        _lists(pa.array(ords[owner]), block), _lists(pa.array(dls[owner]), block), _lists(pa.array(tf.astype(np.int32)), block), _lists(_lists(pa.array(at.astype(np.int32)), one), block),
    ]
    return pa.table(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])


def _blocks(most_docs: int, most_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(ord, dl, tokens) in order to blocks; a window's number is its first document's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        docs = tokens = 0
        for batch in batches:
            start = 0
            for i, dl in enumerate(batch.column("dl").to_pylist()):
                if docs == most_docs or docs and tokens + dl > most_tokens:
                    kept.append(batch.slice(start, i - start))
                    if tokens:
                        yield from _window(pa.Table.from_batches(kept)).to_batches(max_chunksize=ROWS)
                    kept.clear()
                    docs, tokens, start = 0, 0, i
                docs, tokens = docs + 1, tokens + dl
            kept.append(batch.slice(start))
        if tokens:
            yield from _window(pa.Table.from_batches(kept)).to_batches(max_chunksize=ROWS)

    return work


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST else rows


@dataclass(frozen=True)
class Statistics:
    """What scores need of the whole collection: documents, mean length, and each query term's document frequency."""

    n: int
    avgdl: float
    df: dict[str, int]


class SegmentIndex:
    """The index below ``root`` at its newest version, or the one given."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None, *, window: tuple[int, int] = (WINDOW_DOCS, WINDOW_TOKENS)):
        self.window = window
        self.spark, self.root, self.versions = spark, root.rstrip("/"), Versions(spark, root)
        self.version, self.state = self.versions.newest() if version is None else (version, self.versions.read(version))
        self.segments: dict[str, dict] = self.state.get("segments", {})

    def refreshed(self) -> SegmentIndex:
        return SegmentIndex(self.spark, self.root, window=self.window)

    # Tables

    def _table(self, kind: str, columns: str) -> DataFrame:
        """Rows of all living segments; the segment is the folder's name."""
        if not self.segments:
            return self.spark.createDataFrame([], f"{columns}, segment string")
        paths = [f"{self.root}/{kind}/segment={s}" for s in sorted(self.segments)]
        return self.spark.read.option("basePath", f"{self.root}/{kind}").schema(f"{columns}, segment string").parquet(*paths)

    def _id_type(self) -> str:
        return self.state.get("id_type", "long")

    def documents(self) -> DataFrame:
        """(segment, ord, doc_id, dl, tokens) of documents that are not deleted."""
        return self._living(self._table("docs", f"ord long, doc_id {self._id_type()}, dl long, tokens array<string>"))

    def blocks(self) -> DataFrame:
        return self._table("postings", BLOCKS)

    def tombstones(self) -> DataFrame | None:
        """(segment, ord) of deleted documents; null where there are none."""
        names = [t for s in self.segments.values() for t in s["dead"]]
        if not names:
            return None
        rows = self.spark.read.parquet(*[f"{self.root}/dead/{t}" for t in sorted(set(names))])
        return rows.filter(F.col("segment").isin(sorted(self.segments))).select("segment", "ord")

    def _living(self, rows: DataFrame) -> DataFrame:
        dead = self.tombstones()
        gone = sum(v["gone"] for v in self.segments.values())
        return rows if dead is None else rows.join(_few(dead, gone), ["segment", "ord"], "left_anti")

    # Changes

    def _write(self, docs: DataFrame) -> dict[str, dict]:
        """Write (doc_id, tokens) as a segment; what the version needs to know of it, or nothing for no documents."""
        name = uuid.uuid4().hex
        at = f"{self.root}/docs/segment={name}"
        # Ordered within tasks: windows then hold documents of like length, whose bounds differ from other windows'.
        ordered = docs.select("doc_id", "tokens", F.size("tokens").cast("long").alias("dl")).sortWithinPartitions("dl", "doc_id")
        with config.during(self.spark, "spark.sql.files.maxPartitionBytes", str(SPLIT)), config.during(self.spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
            ordered.select(F.monotonically_increasing_id().alias("ord"), "doc_id", "dl", "tokens").write.options(**STORED).parquet(at)
            written = self.spark.read.parquet(at)
            total = written.agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
            if not total["docs"]:
                return {}
            blocks = written.select("ord", "dl", "tokens").mapInArrow(_blocks(*self.window), BLOCKS).sortWithinPartitions("term", "window")
            blocks.write.options(**STORED).parquet(f"{self.root}/postings/segment={name}")
        terms = self.spark.read.parquet(f"{self.root}/postings/segment={name}").groupBy("term").agg(F.sum("n").alias("df"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.options(**STORED).parquet(f"{self.root}/terms/segment={name}")
        return {name: {"docs": total["docs"], "tokens": total["tokens"], "gone": 0, "gone_tokens": 0, "dead": []}}

    def _bury(self, ids: DataFrame, segments: dict[str, dict]) -> dict[str, dict]:
        """Tombstones for the living documents with these ids; the segments as they are then."""
        name = uuid.uuid4().hex
        # Written first: planned along with the documents, they would meet in a shuffle of all tokens.
        named = stored(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "ids")
        found = self.documents().join(_few(named, named.count()), "doc_id", "left_semi")
        found.select("segment", "ord", "dl").write.options(**STORED).parquet(f"{self.root}/dead/{name}")
        rows = self.spark.read.parquet(f"{self.root}/dead/{name}")
        counts = {r["segment"]: r for r in rows.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("t")).collect()}
        if not counts:
            return segments
        tokens = self._table("docs", "ord long, tokens array<string>").join(_few(rows.select("segment", "ord"), sum(c["n"] for c in counts.values())), ["segment", "ord"], "left_semi")
        less = tokens.select("segment", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("segment", "term").agg(F.count("*").alias("df"))
        less.repartitionByRange("term").sortWithinPartitions("term").write.options(**STORED).parquet(f"{self.root}/less/{name}")
        out = {}
        for s, v in segments.items():
            c = counts.get(s)
            out[s] = v | {"gone": v["gone"] + c["n"], "gone_tokens": v["gone_tokens"] + c["t"], "dead": [*v["dead"], name]} if c else v
        return out

    def _commit(self, segments: dict[str, dict], **more) -> SegmentIndex:
        left = {s: v for s, v in segments.items() if v["gone"] < v["docs"]}
        self.versions.commit(self.version, {**self.state, **more, "segments": left})
        return self.refreshed()

    def apply(self, added: DataFrame | None = None, deleted: DataFrame | None = None, **more) -> SegmentIndex:
        """One version that deletes the ids in ``deleted`` and adds (doc_id, text), in place of documents with the same ids.

        ``more`` is kept with the version. Nothing is visible before the whole is written, and another writer's version in
        between makes it fail with :class:`hanji.sources.versions.Conflict`.
        """
        if added is not None and "id_type" not in self.state:
            more["id_type"] = added.schema["doc_id"].dataType.simpleString()
        ids = [x.select("doc_id") for x in (added, deleted) if x is not None]
        segments = dict(self.segments)
        if segments and ids:
            segments = self._bury(reduce(DataFrame.unionByName, ids), segments)
        if added is not None:
            segments |= self._write(added.select("doc_id", tokenize("text").alias("tokens")))
        return self._commit(segments, **more)

    def add(self, docs: DataFrame) -> SegmentIndex:
        return self.apply(added=docs)

    def delete(self, ids: DataFrame) -> SegmentIndex:
        return self.apply(deleted=ids)

    def compact(self, *, every: bool = False) -> SegmentIndex:
        """Rewrite small and mostly deleted segments as one; ``every`` rewrites all."""
        living = {s: v["docs"] - v["gone"] for s, v in self.segments.items()}
        total = sum(living.values())
        some = [s for s, v in self.segments.items() if every or living[s] < SMALL * total or living[s] < LIVING * v["docs"]]
        if not some or (len(some) == 1 and not self.segments[some[0]]["gone"]):
            return self
        made = self._write(self.documents().filter(F.col("segment").isin(some)).select("doc_id", "tokens"))
        return self._commit({s: v for s, v in self.segments.items() if s not in some} | made)

    def sweep(self) -> list[str]:
        """Delete what the newest version does not name. Only while nothing writes and no older version is read."""
        _, state = self.versions.newest()
        segments = state.get("segments", {})
        dead = {t for v in segments.values() for t in v["dead"]}
        folders = {f"segment={s}" for s in segments}
        return [n for kind, named in (("docs", folders), ("postings", folders), ("terms", folders), ("dead", dead), ("less", dead)) for n in self.versions.sweep(kind, named)]

    # Statistics

    def statistics(self, terms: list[str]) -> Statistics:
        """Numbers of the living documents. Only the rows of these terms are read."""
        n = sum(v["docs"] - v["gone"] for v in self.segments.values())
        tokens = sum(v["tokens"] - v["gone_tokens"] for v in self.segments.values())
        counts = self._table("terms", "term string, df long").filter(F.col("term").isin(terms)).select("term", "df")
        dead = sorted({t for v in self.segments.values() for t in v["dead"]})
        if dead:
            less = self.spark.read.schema("segment string, term string, df long").parquet(*[f"{self.root}/less/{t}" for t in dead])
            less = less.filter(F.col("term").isin(terms) & F.col("segment").isin(sorted(self.segments)))
            counts = counts.unionByName(less.select("term", (-F.col("df")).alias("df")))
        df = {r["term"]: r["df"] for r in counts.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").collect()} if terms else {}
        return Statistics(n, tokens / n if n else 0.0, df)

    @staticmethod
    def _idf(stats: Statistics) -> Column:
        values = F.create_map(*[F.lit(v) for t, df in stats.df.items() for v in (t, float(df))])
        return idf(F.lit(float(stats.n)), F.element_at(values, F.col("term")))

    # Searches

    def _wanted(self, terms: list[str]) -> tuple[list[str], Statistics]:
        wanted = sorted({t.lower() for t in terms})
        stats = self.statistics(wanted)
        return [t for t in wanted if t in stats.df], stats

    def _scored(self, blocks: DataFrame, stats: Statistics) -> DataFrame:
        """(segment, ord, score) of the living documents in the blocks."""
        each = blocks.select("segment", "term", F.inline(F.arrays_zip("ords", "dls", "tfs")).alias("ord", "dl", "tf"))
        part = weight(F.col("tf"), F.col("dl"), F.lit(stats.avgdl), self._idf(stats))
        return self._living(each.select("segment", "ord", part.alias("part")).groupBy("segment", "ord").agg(F.sum("part").alias("score")))

    def _ids(self, rows: DataFrame) -> DataFrame:
        docs = self._table("docs", f"ord long, doc_id {self._id_type()}").select("segment", "ord", "doc_id")
        return docs.join(rows, ["segment", "ord"]).select("doc_id", *[c for c in rows.columns if c not in ("segment", "ord")])

    def _nothing(self, columns: str) -> DataFrame:
        return self.spark.createDataFrame([], f"doc_id {self._id_type()}, {columns}")

    def search(self, terms: list[str]) -> DataFrame:
        """(doc_id, score) of all documents with a query term, as :func:`hanji.operators.index.search`."""
        known, stats = self._wanted(terms)
        if not known:
            return self._nothing("score double")
        return self._ids(self._scored(self.blocks().filter(F.col("term").isin(known)), stats))

    def windows(self, known: list[str], stats: Statistics) -> DataFrame:
        """(segment, window, bound): no document of the window can score higher. Reads no postings, only what blocks say of them."""
        heads = self.blocks().filter(F.col("term").isin(known)).select("segment", "window", "term", "max_tf", "min_dl")
        bound = weight(F.col("max_tf"), F.col("min_dl"), F.lit(stats.avgdl), self._idf(stats))
        return heads.groupBy("segment", "window").agg((F.sum(bound) * SLACK).alias("bound"))

    def top(self, terms: list[str], k: int, *, seeds: int = SEED_WINDOWS) -> tuple[DataFrame, dict[str, int]]:
        """The k best (doc_id, score), ties by doc_id, and how many windows there were and how many were scored.

        The windows with the highest bounds are scored first. The k-th score there is a threshold that all others must
        reach with their bound; those that do are scored, the others skipped, and the result is that of :meth:`search`.
        """
        known, stats = self._wanted(terms)
        if not known:
            return self._nothing("score double"), {"windows": 0, "scored": 0}
        blocks, windows = self.blocks().filter(F.col("term").isin(known)), self.windows(known, stats)
        best = lambda rows: self._ids(rows).orderBy(F.col("score").desc(), "doc_id").limit(k)

        def of(chosen: list) -> DataFrame:
            by: dict[str, list[int]] = {}
            for r in chosen:
                by.setdefault(r["segment"], []).append(r["window"])
            inside = [(F.col("segment") == s) & F.col("window").isin(w) for s, w in by.items()]
            return blocks.filter(reduce(Column.__or__, inside))

        first = windows.orderBy(F.col("bound").desc(), "segment", "window").limit(seeds).collect()
        scores = self._scored(of(first), stats).select("score").orderBy(F.col("score").desc()).limit(k).collect()
        least = scores[-1]["score"] if len(scores) == k else 0.0
        counts = windows.agg(F.count("*").alias("all"), F.count_if(F.col("bound") >= least).alias("open")).first()
        if counts["open"] <= PUSHED_WINDOWS:
            open_ = windows.filter(F.col("bound") >= least).select("segment", "window").collect()
            left = of(open_) if open_ else blocks.limit(0)
        else:
            left = blocks.join(windows.filter(F.col("bound") >= least).select("segment", "window"), ["segment", "window"], "left_semi")
        return best(self._scored(left, stats)), {"windows": counts["all"], "scored": counts["open"]}

    def _phrases(self, phrases: list[list[str]]) -> DataFrame:
        """(segment, ord, found): which of the token sequences a document has. Positions meet only within a document."""
        words = sorted({t for p in phrases for t in p})
        each = self.blocks().filter(F.col("term").isin(words)).select("segment", "term", F.inline(F.arrays_zip("ords", "positions")).alias("ord", "pos"))
        held = each.groupBy("segment", "ord").agg(F.map_from_entries(F.collect_list(F.struct("term", "pos"))).alias("at"))
        none = F.array().cast("array<int>")

        def back(i: int):
            return lambda x: x - i

        def starts(phrase: list[str]) -> Column:
            at = [F.transform(F.coalesce(F.try_element_at("at", F.lit(t)), none), back(i)) for i, t in enumerate(phrase)]
            return F.size(reduce(F.array_intersect, at)) > 0

        flags = F.array(*[F.when(starts(p), F.lit(i)) for i, p in enumerate(phrases)])
        return self._living(held.select("segment", "ord", F.array_compact(flags).alias("found")))

    def phrase(self, tokens: list[str]) -> DataFrame:
        """(doc_id) of documents where these tokens follow one another."""
        if not tokens:
            return self._nothing("found array<int>").select("doc_id")
        return self._ids(self._phrases([tokens]).filter(F.size("found") > 0).select("segment", "ord"))

    def matching(self, query: BooleanQuery, split) -> DataFrame:
        """(doc_id) of documents that satisfy a boolean query whose words and phrases are token sequences.

        ``split`` makes tokens of a phrase. A literal without tokens is satisfied by every document. All documents are read
        only where a query names nothing that must occur.
        """
        literals = list(dict.fromkeys([*query.phrases, *query.excludes, *(w for c in query.clauses for w in c)]))
        tokens = {x: split(x) for x in literals}
        asked = [x for x in literals if tokens[x]]
        has = lambda x: F.array_contains("found", asked.index(x)) if tokens[x] else F.lit(True)
        every = lambda xs: reduce(Column.__and__, map(has, xs), F.lit(True))
        ok = every(query.phrases) & reduce(Column.__and__, [~has(x) for x in query.excludes], F.lit(True))
        if query.clauses:
            ok = ok & reduce(Column.__or__, map(every, query.clauses))
        needed = any(tokens[x] for x in query.phrases) or (query.clauses and all(any(tokens[w] for w in c) for c in query.clauses))
        found = self._phrases([tokens[x] for x in asked]) if asked else None
        if not needed:
            docs = self.documents().select("segment", "ord")
            empty = F.array().cast("array<int>")
            found = docs.withColumn("found", empty) if found is None else docs.join(found, ["segment", "ord"], "left").withColumn("found", F.coalesce("found", empty))
        return self._ids(found.filter(ok).select("segment", "ord"))
