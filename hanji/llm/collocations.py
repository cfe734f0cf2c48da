"""Phrases whose words belong together, by word-id suffix arrays (operator 12).

Tasks gather texts into shards of a few megabytes, number their words (per language, so that languages never
mix), and sort the suffixes of the shard's id sequence by numpy prefix doubling, as deep as phrases are long. Intervals
of the suffix array whose inner common prefixes have n words or more are the shard's n-grams with their counts; those
that would run over the end of a piece are left out. Counts are merged by language and phrase in Spark: exactly, the
phrase itself is the key.

Two passes keep the shuffle near the size of the text. The first counts words and pairs. A longer phrase can only be
frequent if all its pairs are, so the second pass cuts pieces wherever a pair is rare and counts three to five words of
what is left. Which pairs are frequent travels as a bit table of fixed size over their hashes (:data:`FILTER_BITS`): a pair
that shares its bit with a frequent one costs work, never a wrong count, however full the table is.

Candidates are then cut, scored in exact decimals, freed of those that a longer candidate covers, and ranked, by joins on
language and phrase. A longer candidate that covers one occurs as often as it, and so do all between them, so only
candidates of one word more need be asked.

Defined cases: null texts are empty; a null language is ``und``, as is the language of that name; repeated rows count each
time; texts of any length are counted whole, very long ones in stretches that end with a piece; texts without words
count nothing; an empty table gives no rows; null ids and extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanji.llm.common import keep, read, release, settle, text_batches

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text that a shard has, about, and of the stretches that very long texts are cut to; rows that leave a task at once.
SHARD_BYTES, STRETCH, ROWS = 4 << 20, 1 << 20, 50_000
FILTER_BITS = 1 << 26
#: Parts in which each language's candidates are cut to the best before they meet.
PARTS = 16
COUNTS = "lang string, phrase string, n int, f long"

#: Marks that end a piece become full stops, blanks become spaces, and A-Z lower case.
_TABLE = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = ord(".")
_TABLE[ord("\t")] = ord(" ")
for _c in range(ord("A"), ord("Z") + 1):
    _TABLE[_c] = _c + 32
_TABLE = bytes(_TABLE)


# Shards


class Shard:
    """Translated texts by language, until they are numbered."""

    def __init__(self):
        self.texts: dict[str, list[bytes]] = {}
        self.size = 0

    def add(self, lang: str, stretch: bytes) -> None:
        """Append a stretch of translated text; it ends a piece."""
        self.texts.setdefault(lang, []).append(stretch)
        self.size += len(stretch) + 1

    def numbered(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """The word ids of all texts, 0 at the ends of pieces, and each id's word and language."""
        ids, words, langs, known = [np.zeros(1, np.int64)], [pa.array([b""], pa.binary())], [pa.array([None], pa.string())], 1
        for lang, texts in self.texts.items():
            data = np.frombuffer(b".".join((*texts, b"")), np.uint8)
            end, word = data == 46, data != 32
            # Where a word or a mark begins: after a blank or a mark, or at one.
            begins = word & np.concatenate(([True], end[:-1] | ~word[:-1])) | end
            starts = np.append(np.flatnonzero(begins[word]), np.count_nonzero(word)).astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data[word])])
            coded = values.dictionary_encode()
            number = np.arange(known, known + len(coded.dictionary))
            number[coded.dictionary.index(b".").as_py()] = 0
            ids.append(number[coded.indices.to_numpy()])
            words.append(coded.dictionary)
            langs.append(pa.repeat(pa.scalar(lang, pa.string()), len(coded.dictionary)))
            known += len(coded.dictionary)
        return np.concatenate(ids), pa.concat_arrays(words), pa.concat_arrays(langs)


def stretches(text: bytes) -> Iterator[bytes]:
    """A text, translated, cut at ends of pieces about every :data:`STRETCH` bytes."""
    text = text.translate(_TABLE)
    start = 0
    while len(text) - start > STRETCH:
        cut = text.find(b".", start + STRETCH)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


# Suffix arrays


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 in the order of the keys, equal ones alike."""
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


def _later(rank: np.ndarray, by: int) -> np.ndarray:
    """What stands ``by`` places later; 0, the end of a piece, past the end."""
    return np.concatenate((rank[by:], np.zeros(min(by, len(rank)), rank.dtype)))


def suffix_array(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the ``depth`` words from there, and how many of them each place shares with the one before.

    Ranks by the first h words give ranks by the first 2h; the last step joins two runs that may overlap, so that the order
    is by ``depth`` words exactly.
    """
    ranks, h = {1: s}, 1
    while 2 * h < depth:
        rank = ranks[h]
        ranks[2 * h] = _dense(rank * (int(rank.max(initial=0)) + 1) + _later(rank, h))
        h *= 2
    rank = ranks[h]
    order = np.argsort(rank * (int(rank.max(initial=0)) + 1) + _later(rank, depth - h) if depth > h else rank)
    a, b = order[:-1], order[1:]
    common = np.zeros(max(0, len(order) - 1), np.int64)
    for step in (h, *sorted(ranks, reverse=True)):
        padded = np.concatenate((ranks[step], np.full(4 * depth, -1, np.int64)))
        common += step * (padded[a + common] == padded[b + common])
    return order, np.concatenate((np.zeros(min(1, len(order)), np.int64), np.minimum(common, depth)))


def reach(s: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its piece."""
    ends = np.flatnonzero(s == 0)
    places = np.arange(len(s))
    after = np.searchsorted(ends, places)
    return np.concatenate((ends, [len(s)]))[after] - places


def grams(s: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each n-gram within pieces, how often it occurs) for n from ``least`` to ``most``."""
    order, common = suffix_array(s, most)
    room = reach(s)[order]
    for n in range(least, most + 1):
        first = np.flatnonzero(common < n)
        counts = np.diff(np.append(first, len(order)))
        whole = room[first] >= n
        yield n, order[first[whole]], counts[whole]


def chains(s: np.ndarray, frequent: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The stretches of three words and more all of whose pairs are frequent, as pieces. ``frequent`` judges places of pairs."""
    good = np.zeros(len(s) + 1, bool)
    places = np.flatnonzero((s[:-1] > 0) & (s[1:] > 0))
    if len(places):
        keys = s[places] * (int(s.max()) + 1) + s[places + 1]
        order = np.argsort(keys)
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))
        good[places[order]] = np.repeat(frequent(places[order[first]]), np.diff(np.append(first, len(order))))
    three = good[:-1] & good[1:]
    kept = three.copy()
    kept[1:] |= three[:-1]
    kept[2:] |= three[:-2]
    places = np.flatnonzero(kept)
    ends = ~(good[places] & np.append(kept, False)[places + 1])
    out = np.zeros(len(places) + int(ends.sum()), np.int64)
    out[np.arange(len(places)) + np.cumsum(ends) - ends] = s[places]
    return out


# Passes


def _phrases(words: pa.Array, s: np.ndarray, places: np.ndarray, n: int) -> pa.Array:
    blank = pa.scalar(b" ", pa.binary()).cast(words.type)
    return pc.binary_join_element_wise(*[words.take(pa.array(s[places + i])) for i in range(n)], blank) if n > 1 else words.take(pa.array(s[places]))


def counted(docs: DataFrame, *, text: str, lang: str, frequent: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n, f) of shards: of words and pairs, or, given the table of frequent pairs, of longer phrases.

    Without a table, a row without phrase has the number of all words of its language in the shard.
    """
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def count(shard: Shard) -> Iterator[pa.RecordBatch]:
        s, raw, langs = shard.numbered()
        shard.texts.clear()
        words = raw.cast(pa.string())
        out = lambda *columns: pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=names)
        if held is None:
            each = pc.value_counts(langs.take(pa.array(s[s > 0])))
            yield out(each.field("values"), pa.nulls(len(each), pa.string()), np.zeros(len(each), np.int32), each.field("counts"))
            found = grams(s, 1, 2)
        else:
            table, hashes = held.value, [np.fromiter(map(zlib.crc32, x.to_pylist()), np.int64, len(x)) for x in (langs.cast(pa.binary()).fill_null(b""), raw)]

            def judge(places: np.ndarray) -> np.ndarray:
                bits = pair_bits(hashes[0][s[places]], hashes[1][s[places]], hashes[1][s[places + 1]], len(table) * 64)
                return (table[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

            s = chains(s, judge)
            found = grams(s, 3, longest) if longest > 2 else ()
        for n, places, counts in found:
            for a in range(0, len(places), ROWS):
                some = places[a : a + ROWS]
                yield out(langs.take(pa.array(s[some])), _phrases(words, s, some, n), np.full(len(some), n, np.int32), counts[a : a + ROWS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for stretch in stretches(body):
                    shard.add(name, stretch)
                    if shard.size >= shard_bytes:
                        yield from count(shard)
                        shard = Shard()
        if shard.size:
            yield from count(shard)
        release()

    chosen = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    return chosen.filter("text IS NOT NULL").mapInArrow(work, COUNTS)


def pair_bits(lang, first, second, bits: int):
    """The bit of a pair of words, from the CRC-32 of language and words: numbers in numpy or in Spark."""
    return (lang + 7919 * first + 104_729 * second) % bits


def bit_table(pairs: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each hash of (lang, phrase): the bits are gathered in Spark; what returns has a fixed size."""
    words = F.split("phrase", " ")
    bit = pair_bits(*[F.crc32(x.cast("binary")) for x in (F.col("lang"), words[0], words[1])], bits)
    got = pairs.select(bit.alias("bit")).selectExpr("cast(bit div 64 as int) AS at", "shiftleft(1L, cast(bit % 64 as int)) AS word").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[got["at"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    return table


def frequencies(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n, f) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, total) words."""

    def merged(counts: DataFrame) -> DataFrame:
        return settle(counts.groupBy("lang", "phrase", "n").agg(F.sum("f").alias("f")).filter(F.col("phrase").isNull() | (F.col("f") >= least)))

    short = merged(counted(docs, text=text, lang=lang, shard_bytes=shard_bytes))
    totals = keep(short.filter("phrase IS NULL").select("lang", F.col("f").alias("total")))
    short = short.filter("phrase IS NOT NULL")
    long = merged(counted(docs, text=text, lang=lang, frequent=bit_table(short.filter("n = 2"), bits), shard_bytes=shard_bytes, longest=longest))
    return short.unionByName(long), totals


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of all phrases of two words and more, by their lowest-scoring cut."""
    cut = found.filter("n > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    joined = lambda words: F.array_join(words, " ")
    cut = cut.select("lang", "phrase", "a", "k", joined(F.slice("w", F.lit(1), F.col("k"))).alias("first"), joined(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("rest"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(38, 0)) * a * total) div (cast(l as decimal(38, 0)) * r)")
    best = both.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", F.col("total").alias("n"), "b.score")


def uncovered(found: DataFrame) -> DataFrame:
    """(lang, phrase) of the phrases of two words and more that no longer one covers."""
    w = F.split("phrase", " ")
    shorter = F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " ")))
    cover = found.filter("n > 2").select("lang", shorter.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    rows = found.filter("n > 1").join(cover, ["lang", "phrase"], "left")
    return rows.filter("most IS NULL OR 100 * most < 100 * f").select("lang", "phrase")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The best of each language with ranks. Parts of a language are cut to ``top`` rows before they meet in one task."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, *, top: int = TOP, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): see the module."""
    found, totals = frequencies(docs, **how)
    left = scored(found, totals).join(uncovered(found), ["lang", "phrase"])
    return ranked(left, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {n - 1}], ' ') AS phrase, {n} AS n FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n})" for n in range(1, LONGEST + 1))
OP12_SQL = rf"""WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
totals AS (SELECT lang, sum(len(w)) AS total FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, phrase, n, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, n)) AS k FROM f WHERE n > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.total, (1000::HUGEINT * c.a * t.total) // (x.f::HUGEINT * y.f) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.n > len(string_split(b.phrase, ' ')) AND 100 * q.f >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000"""
