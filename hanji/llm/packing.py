"""Best-fit packing with bounds that certify each partition (operator 8).

Documents are tokenized once; only those longer than a sequence are cut. Pieces are dealt to partitions of bounded size by
a hash of each row, so that pieces of one repeated id are spread like any others; each partition is packed by best-fit decreasing. A dual-feasible-function bound on the partition's piece lengths tells how few
sequences any packing could use: where it equals the number used, the partition is certified optimal. Partitions with
a gap, or with free room that a neighbour's documents could fill, exchange documents: groups of them give up their sequences that are not full, and the pieces of a whole group are
packed anew, best-fit decreasing; the new packing stands where it needs fewer sequences. After each round, groups
differ, so that documents meet others.

Defined cases: null text is empty and, like empty text, packs as the single separator; pieces of repeated ids are packed
as separate pieces and cut alike; very long texts are tokenized whole; ties go by doc_id and piece; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanji.llm.common import keep, release, settle, text_batches

CAPACITY, SEPARATOR = 2048, 0
#: Tokens that one partition packs, about; bounds the memory and time of a packing task.
PARTITION_TOKENS = 4_000_000
#: A sequence id is a partition's number times this, plus the sequence's number there; partitions have fewer sequences, as
#: they have :data:`PARTITION_TOKENS` tokens, about. Rounds of exchange number their partitions from multiples of 2**36.
BINS, ROUND_BITS = 1 << 23, 36
#: Partitions with a gap that exchange documents together, and how often.
GROUP, ROUNDS = 8, 2
#: Distinct parts of texts whose ids a Python worker remembers, about, in each half of its memory, and their mean length.
MEMO_PARTS, MEMO_LENGTH = 200_000, 20
#: Latin letters beyond ASCII whose lower case is one letter; none composes with what follows.
_LATIN = "\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
_FOREIGN = re.compile(f"[^\x00-\x7f{_LATIN}]").search
#: A part that :data:`_UNITS` may cut: no white space or control characters, and short.
_SIMPLE = re.compile(f"[!-~{_LATIN}]{{1,256}}").fullmatch
#: The vocabulary's splitter, for lower-cased simple parts.
_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+").findall
#: Marks that a stop or comma right after them would join.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "".join(map(chr, [*range(9), *range(14, 32), 127]))
_JOINED = tuple((m, m + ".", m + ",") for m in _MARKS)


def _unusual(text: str) -> bool:
    """Whether a text must take the plain way."""
    if "<|" in text or not text.isascii() and _FOREIGN(text):
        return True
    return any(stop in text or comma in text for mark, stop, comma in _JOINED if mark in text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _unit_tokenizer(path: str):
    """The same model for lower-cased units between blanks: nothing to normalize, nothing else to split."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer(_tokenizer(path).model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


@cache
def _last_ids(path: str) -> np.ndarray:
    """Which ids end a unit of the splitter."""
    vocabulary = _tokenizer(path).get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return last


class WordTokens:
    """Ids of whole texts from remembered ids of their parts.

    The vocabulary's splitter lower-cases, never lets a token cross white space, and parts letters from other characters.
    So a text's ids are those of its parts between blanks and line feeds, one after another, and a text of plain Latin
    letters may be lower-cased, and a full stop or comma that ends a word cut off, beforehand. The last id of a unit of the
    splitter is one of a known set, so many parts are encoded as one text and cut after those ids: simple parts as their
    units, which need no normalizer, and other letters, which are one unit, as they are. The memory is bounded in parts and
    characters: when its younger half is full, the older half is forgotten.
    """

    def __init__(self, path: str, limit: int = MEMO_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads; the library's own take more CPU
        self.tokenizer, self.unit_tokenizer, self.limit, self.last = _tokenizer(path), _unit_tokenizer(path), limit, _last_ids(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    @staticmethod
    def spaced(text: str) -> str:
        """The text with its parts between blanks."""
        if _unusual(text):
            return text.replace("\n", " ")
        return (text.lower() + " ").replace("\n", " ").replace(". ", " . ").replace(", ", " , ")

    def _plain(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, keys: set[str]) -> None:
        if len(self.young) > self.limit or self.chars > MEMO_LENGTH * self.limit:
            self.young, self.old, self.chars = {}, self.young, 0
        keys = keys.difference(self.young)
        self.chars += sum(map(len, keys))
        again = {k for k in keys if k in self.old}
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        simple, units, counts, letters, others = [], [], [], [], []
        for k in keys.difference(again):
            low = k.lower()
            if _SIMPLE(low) and (low == k or _SIMPLE(k)) and "<|" not in k:
                found = [low] if low.isalpha() else _UNITS(low)
                simple.append(k)
                units.append(" ".join(found))
                counts.append(len(found))
            else:
                (letters if k.isalpha() else others).append(k)
        self.young.update(zip(others, self._plain(others), strict=True))
        self._bulk(self.unit_tokenizer, simple, units, counts)
        self._bulk(self.tokenizer, letters, letters, [1] * len(letters))

    def _bulk(self, tokenizer, keys: list[str], texts: list[str], counts: list[int]) -> None:
        """Learn ``keys`` from ``texts``, which hold their units between blanks, ``counts`` of them."""
        for i in range(0, len(keys), 4096):
            part, text = keys[i : i + 4096], texts[i : i + 4096]
            found = tokenizer.encode_batch_fast([" ".join(text[k : k + 64]) for k in range(0, len(text), 64)], add_special_tokens=False)
            ids = np.array([x for e in found for x in e.ids], "<u4")
            cuts, at = np.flatnonzero(self.last[ids]) + 1, np.cumsum(counts[i : i + 4096])
            if len(cuts) != at[-1]:
                self.young.update(zip(part, self._plain(part), strict=True))
                continue
            raw, ends = ids.tobytes(), (4 * cuts[at - 1]).tolist()
            self.young.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for i in range(0, len(texts), 1024):
            split = pc.split_pattern(pa.array(map(self.spaced, texts[i : i + 1024]), pa.large_string()), " ")
            parts = split.flatten().dictionary_encode()
            keys = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
            self._learn(set(keys))
            raw = pa.array(map(self.young.__getitem__, keys), pa.large_binary()).take(parts.indices)
            _, places, ids = raw.buffers()
            ends = np.frombuffer(places, np.int64)[split.offsets.to_numpy()].tolist()
            for start, end in zip(ends, ends[1:], strict=False):
                yield ids[start:end].to_pybytes() if end > start else b""


@cache
def _word_tokens(path: str) -> WordTokens:
    """One memory a Python worker: its later tasks meet the same words."""
    return WordTokens(path)


def pieces(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document."""
    text_batches(docs.sparkSession)
    path = path or default_vocabulary()
    end = np.array([separator], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for doc_id, raw in zip(ids, tokens.encode(texts), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. ``lengths`` may be in any order; ties keep it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    used = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        k = bisect_left(rooms, n)
        if k == len(rooms):
            b, room = used, capacity
            used += 1
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
        bins[i], offsets[i] = b, capacity - room
        room -= n
        if room:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append(b)
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: the best of the dual-feasible functions tried.

    For each k, lengths over capacity - k count as whole sequences, those under k as nothing, others in proportion; of
    the lengths so changed, u(j) rounds ``(j + 1) * length / capacity`` down (or takes length itself where that is whole).
    And for each k, a length up to half the capacity counts twice the times that k goes into it, a longer one what that
    leaves of a whole sequence's count for the rest of its sequence.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.flatnonzero(count)
    if not len(size):
        return 0
    count = count[size]
    ks = np.unique(np.concatenate(([0], size[2 * size <= capacity], (capacity - size[2 * size > capacity] + 1)[2 * (capacity - size[2 * size > capacity] + 1) <= capacity])))
    best = 0
    for at in range(0, len(ks), 256):
        k = ks[at : at + 256, None]
        cut = np.where(size > capacity - k, capacity, np.where(size < k, 0, size))
        best = max(best, int((-(-(cut @ count) // capacity)).max()))
        for j in range(1, 12):
            scaled = (j + 1) * cut
            value = np.where(scaled % capacity == 0, cut * j, scaled // capacity * capacity)
            best = max(best, int((-(-(value @ count) // (j * capacity))).max()))
    for j in range(12, 40):
        scaled = (j + 1) * size
        value = np.where(scaled % capacity == 0, size * j, scaled // capacity * capacity)
        best = max(best, int(-(-(value @ count) // (j * capacity))))
    for at in range(1, capacity // 2 + 1, 256):
        k = np.arange(at, min(at + 256, capacity // 2 + 1))[:, None]
        value = np.where(2 * size > capacity, 2 * (capacity // k - (capacity - size) // k), np.where(2 * size == capacity, capacity // k, 2 * (size // k)))
        best = max(best, int((-(-(value @ count) // (2 * (capacity // k[:, 0])))).max()))
    return best


def pack(parts: DataFrame, *, capacity: int = CAPACITY, partition_tokens: int = PARTITION_TOKENS, rounds: int = ROUNDS, group: int = GROUP):
    """(packed pieces with sequence_id and offset, certificates with part, used, bound).

    ``parts`` is read several times and its rows are dealt by their places in it, so it should be a written table.
    """
    spark = parts.sparkSession
    total = parts.agg(F.sum("length")).first()[0] or 0
    n_parts = max(1, -(-total // partition_tokens))
    packed_schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, used long, bound long"
    names = [c.split()[0] for c in packed_schema.split(", ")]
    by_id = [(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")]

    def placed(table: pa.Table, part) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        found = {"part": part, "bin": bins, "offset": offsets, "used": used, "bound": lower_bound(lengths, capacity)}
        for name, value in found.items():
            column = pa.array(np.broadcast_to(np.asarray(value, np.int64), len(table)).copy())
            at = table.schema.get_field_index(name)
            table = table.append_column(name, column) if at < 0 else table.set_column(at, name, column)
        return table.select(names)

    def pack_part(table: pa.Table) -> pa.Table:
        return placed(table.sort_by(by_id), table.column("part").to_numpy())

    def repacker(r: int):
        def repack(table: pa.Table) -> pa.Table:
            table = table.sort_by(by_id)
            tried = placed(table, (np.int64(r) << ROUND_BITS) + table.column("meet").to_numpy())
            before = table.group_by(["part", "bin"]).aggregate([]).num_rows
            return tried if tried.column("used")[0].as_py() < before else table.select(names)

        return repack

    dealt = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_parts)))
    packed = keep(dealt.groupBy("part").applyInArrow(pack_part, packed_schema))
    certificates = packed.groupBy("part").agg(F.first("used").alias("used"), F.first("bound").alias("bound"), F.sum("length").alias("tokens"))
    for r in range(1, rounds + 1):
        gaps = keep(certificates.filter(f"used > bound OR used * {capacity} > tokens").select("part", "used", "bound"))
        n_gaps = gaps.count()
        if n_gaps == 0 or (n_gaps == 1 and gaps.filter("used > bound").isEmpty()):
            break
        n_groups = -(-n_gaps // group)
        grouped = gaps.withColumn("meet", F.pmod(F.xxhash64("part", F.lit(r)), F.lit(n_groups)))
        mine = packed.join(F.broadcast(grouped.select("part", "meet")) if n_gaps <= 50_000 else grouped.select("part", "meet"), "part", "left")
        full = mine.filter("meet IS NULL").drop("meet")
        given = mine.filter("meet IS NOT NULL")
        fill = given.groupBy("part", "bin").agg(F.sum("length").alias("fill"))
        loose = given.join(fill, ["part", "bin"])
        full = full.unionByName(loose.filter(F.col("fill") == capacity).drop("meet", "fill"))
        loose = loose.filter(F.col("fill") < capacity)

        packed = keep(full.unionByName(loose.groupBy("meet").applyInArrow(repacker(r), packed_schema)))
        per_part = packed.groupBy("part", "bin").agg(F.sum("length").alias("fill"), F.first("bound").alias("bound")).groupBy("part")
        certificates = per_part.agg(F.count("*").alias("used"), F.when(F.min("fill") == capacity, F.count("*")).otherwise(F.max("bound")).alias("bound"), F.sum("fill").alias("tokens"))
    return packed.withColumn("sequence_id", F.col("part") * BINS + F.col("bin")), certificates


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed, _ = pack(settle(pieces(docs)))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
