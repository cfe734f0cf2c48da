"""Which texts contain which patterns, without comparing every text with every pattern.

A text that contains a pattern has all of the pattern's grams. Patterns are classed by their length in bytes, to the next
power of two, and a class has grams of one size: up to eight bytes, so that a gram is an integer. Each pattern is filed
under the one of its grams that occurs least; texts meet patterns on these grams in an equi join, and what meets is
verified. Two passes over the texts find grams, one to count them and one to meet on them. A pass goes over the bytes of
a batch and leaves out at once what a table of a fixed number of bits does not have; a full table costs work, no result.
What meets is not the text but the window of it that holds a pattern wherever its gram lies, so no text is shuffled.

A null text contains nothing; a null or empty pattern is in no pair; rows with equal keys are texts, and patterns, of their
own: each pair of rows counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanji import config
from hanji.sources.versions import stored

#: Bits of a gram's number in the table; places looked at in one go; bytes of texts that a task gets at once.
BITS, PLACES, BATCH_BYTES = 20, 1 << 20, 4 << 20
#: An odd factor whose product's upper bits deal grams evenly.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _size(kind: int) -> int:
    """Bytes of a gram of the patterns of more than ``kind / 2`` and up to ``kind`` bytes."""
    return min(8, kind // 2 + 1)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, and the last one ends, and all bytes, with eight more."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    begin = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
    return begin - begin[0], np.append(data, np.zeros(8, np.uint8))


def _grams(data: np.ndarray, at: int, stop: int, n: int) -> np.ndarray:
    """The n bytes from each place on, as integers."""
    return np.ndarray(stop - at, "<u8", data, at, (1,)) & np.uint64(2 ** (8 * n) - 1)


def _number(grams: np.ndarray) -> np.ndarray:
    return (grams * FACTOR) >> np.uint64(64 - BITS)


def _hits(begin: np.ndarray, data: np.ndarray, n: int, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, gram) of grams that the table has, some places at a time."""
    for at in range(0, int(begin[-1]), PLACES):
        grams = _grams(data, at, min(at + PLACES, int(begin[-1])), n)
        place = np.flatnonzero(table[_number(grams)])
        grams, place = grams[place], place + at
        text = np.searchsorted(begin, place, "right") - 1
        whole = place + n <= begin[text + 1]
        yield text[whole], place[whole], grams[whole]


def _tables(numbers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    out = {kind: np.zeros(1 << BITS, bool) for kind in numbers}
    for kind, some in numbers.items():
        out[kind][some] = True
    return out


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns to their grams, each with its first place and its number."""
    for batch in batches:
        for pattern in batch.column(0).to_pylist():
            size = len(pattern.encode())
            kind = 1 << (size - 1).bit_length()
            data = np.append(np.frombuffer(pattern.encode(), np.uint8), np.zeros(8, np.uint8))
            grams, place = np.unique(_grams(data, 0, size - _size(kind) + 1, _size(kind)), return_index=True)
            many = len(grams)
            yield pa.record_batch({
                "_s": pa.array([pattern] * many, pa.string()), "_l": pa.array([size] * many, pa.int32()), "_c": pa.array([kind] * many, pa.int32()), "_g": pa.array(grams.view(np.int64)),
                "_o": pa.array(place.astype(np.int32)), "_b": pa.array(_number(grams).astype(np.int32)),
            })


def _counted(numbers: dict[int, np.ndarray]):
    """Texts to (class, gram, times)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(numbers)
        for batch in batches:
            begin, data = _bytes(batch.column(0))
            for kind, table in tables.items():
                for _, _, grams in _hits(begin, data, _size(kind), table):
                    found, times = np.unique(grams, return_counts=True)
                    yield pa.record_batch({"_c": pa.array(np.full(len(found), kind, np.int32)), "_g": pa.array(found.view(np.int64)), "_n": pa.array(times.astype(np.int64))})

    return work


def _windows(numbers: dict[int, np.ndarray], reach: dict[int, tuple[int, int]]):
    """(row, key, text) to (row, key, class, gram, window): what lies around a gram as far as its class reaches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(numbers)
        for batch in batches:
            begin, data = _bytes(batch.column(2))
            for kind, table in tables.items():
                before, after = reach[kind]
                for text, place, grams in _hits(begin, data, _size(kind), table):
                    first, last = np.maximum(place - before, begin[text]), np.minimum(place + after, begin[text + 1])
                    size = last - first
                    end = np.cumsum(size)
                    held = data[np.arange(end[-1] if len(end) else 0) - np.repeat(end - size - first, size)]
                    window = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, end).astype(np.int64)), pa.py_buffer(held)])
                    once = pa.table({"t": text, "_g": grams.view(np.int64), "_w": window.cast(pa.binary())}).group_by(["t", "_g", "_w"]).aggregate([])
                    row, key = (batch.column(i).take(once["t"].combine_chunks()) for i in (0, 1))
                    made = pa.table({"_r": row, "_k": key, "_c": pa.array(np.full(len(once), kind, np.int32)), "_g": once["_g"], "_w": once["_w"]})
                    yield from made.combine_chunks().to_batches()

    return work


def _numbers(filed: DataFrame) -> dict[int, np.ndarray]:
    """The numbers of each class's grams: at most 2^BITS a class."""
    rows = filed.select("_c", "_b").distinct().toArrow()
    kind, number = rows["_c"].to_numpy(), rows["_b"].to_numpy()
    return {int(c): number[kind == c] for c in np.unique(kind)}


def contains_join(texts: DataFrame, patterns: DataFrame, *, key: str = "doc_id", text: str = "text", name: str = "pattern_id", pattern: str = "pattern") -> DataFrame:
    """(key, name) of all pairs where the text contains the pattern."""
    spark = texts.sparkSession
    asked = patterns.select(F.col(name).alias("_p"), F.col(pattern).alias("_s")).filter("length(_s) > 0")
    rows = texts.select(F.monotonically_increasing_id().alias("_r"), F.col(key).alias("_k"), F.col(text).alias("_t"))
    with config.during(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        filed = stored(asked.select("_s").distinct().mapInArrow(_filed, "_s string, _l int, _c int, _g long, _o int, _b int"))
        numbers = _numbers(filed)
        if not numbers:
            return texts.select(F.col(key)).join(patterns.select(F.col(name)).limit(0), F.lit(False))
        counts = rows.select("_t").mapInArrow(_counted(numbers), "_c int, _g long, _n long").groupBy("_c", "_g").agg(F.sum("_n").alias("_n"))
        # A pattern with a gram that no text has is in no pair.
        rarest = filed.join(counts, ["_c", "_g"], "left").groupBy("_s", "_l", "_c").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g", "_o", "_b")).alias("_m"))
        keys = stored(rarest.filter("_m.n > 0").select("_s", "_l", "_c", "_m.*"))
        reach = {r["_c"]: (r["b"], r["a"]) for r in keys.groupBy("_c").agg(F.max("_o").alias("b"), F.max(F.col("_l") - F.col("_o")).alias("a")).collect()}
        kind = texts.schema[key].dataType.simpleString()
        windows = stored(rows.mapInArrow(_windows(_numbers(keys), reach), f"_r long, _k {kind}, _c int, _g long, _w binary"))
    found = windows.join(keys, ["_c", "_g"]).filter(F.contains("_w", F.col("_s").cast("binary"))).select("_r", "_k", "_s").distinct()
    return found.join(asked, "_s").select(F.col("_k").alias(key), F.col("_p").alias(name))
