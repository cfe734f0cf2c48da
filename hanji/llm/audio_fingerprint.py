"""Chroma audio fingerprints of a media column (operator 1).

A recording (PCM WAV bytes) is cut into overlapping frames; each frame's spectrum is folded into twelve pitch classes.
Over the image of frames and pitch classes, sixteen rectangle filters are evaluated from its integral image; each is
quantized to two bits by a Gray code, which packs into one 32-bit integer per frame. Two recordings are aligned by the
histogram of offsets at which their integers agree, and judged by the share of bits that differ over the overlap.

For a search, recordings with equal fingerprints form one class. Each class is indexed under landmarks, hashes of its codes
(the robust bit of each filter, at two places): in each stretch of :data:`LANDMARK_WINDOW` frames the smallest is one, a
choice that similar recordings, and clips of a recording, make alike. So landmarks grow with the length, and every
fingerprint has one. Classes that share a landmark with a query's class are aligned on their whole fingerprints; a
landmark of very many classes is split by salt, so that no task holds all of them.

Defined cases: null, damaged or non-PCM bytes, and recordings shorter than the filters, have an empty fingerprint and
match nothing; repeated rows are members of one class; an id with several recordings is in a class for each; ties between alignments go to the one with fewer bit errors, then
the smaller offset; long recordings of one tone are aligned in memory that grows with their length; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanji.llm.common import keep, release, settle, text_batches

FRAME_SECONDS, HOP_SECONDS = 0.256, 0.064
LOWEST, HIGHEST = 55.0, 1760.0
#: (kind, first pitch class, pitch classes, frames): kinds compare halves or thirds of the rectangle, see :func:`_filter`.
FILTERS = tuple((2 if h == 12 else k % 6, (5 * k) % 12 % (13 - h), h, w) for k, (h, w) in enumerate([(4, 4), (6, 8), (3, 6), (8, 4), (4, 12), (6, 6), (12, 8), (3, 12)] * 2))
WIDTH = 12
#: Log ratios at which a filter's two bits change.
CUTS = (-0.25, 0.0, 0.25)
LANDMARK_WINDOW, LANDMARK_GAP = 6, 8
#: Classes under one landmark that one task joins with the queries, about.
MARK_CLASSES = 2000
#: Share of differing bits up to which recordings match, and frames that must overlap, as a share of the shorter one.
MOST_ERRORS, LEAST_OVERLAP, LEAST_FRAMES = 0.1, 0.5, 8


def read_wav(raw: bytes | None) -> tuple[np.ndarray, int] | None:
    """Mono samples in [-1, 1] and the rate, or None where the bytes are no PCM WAV."""
    if not raw or len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(raw) and data is None:
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None or form[0] not in (1, 0xFFFE) or not form[1] or not form[2]:
        return None
    channels, rate, bits = form[1], form[2], form[5]
    if bits == 8:
        x = np.frombuffer(data, np.uint8).astype(np.float32) / 128 - 1
    elif bits == 16:
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768
    elif bits == 24:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    elif bits == 32:
        x = np.frombuffer(data[: len(data) // 4 * 4], "<i4").astype(np.float32) / (1 << 31)
    else:
        return None
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    data = np.clip(np.rint(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


@cache
def _fold(rate: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    frame, hop = max(16, round(FRAME_SECONDS * rate)), max(1, round(HOP_SECONDS * rate))
    freq = np.fft.rfftfreq(frame, 1 / rate)
    fold = np.zeros((len(freq), 12), np.float32)
    used = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
    fold[used, np.rint(12 * np.log2(freq[used] / 440)).astype(int) % 12] = 1
    return frame, hop, np.hanning(frame).astype(np.float32), fold


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12) energies, each frame scaled to length one; silent frames are zero."""
    frame, hop, window, fold = _fold(rate)
    if len(samples) < frame:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    out = np.concatenate([np.abs(np.fft.rfft(frames[i : i + 256] * window, axis=1)) ** 2 @ fold for i in range(0, len(frames), 256)])
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-3), 0)


def _filter(image: np.ndarray, kind: int, y: int, h: int, w: int, n: int) -> np.ndarray:
    """Log ratio of two parts of the rectangle from the integral image, for its ``n`` places in time."""

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return image[x1 : x1 + n, y1] - image[x0 : x0 + n, y1] - image[x1 : x1 + n, y0] + image[x0 : x0 + n, y0]

    top, x_half, y_half = y + h, w // 2, y + h // 2
    whole = area(0, w, y, top)
    if kind == 0:  # the whole against the frame band above it, around the circle of pitches
        part = area(0, w, 0, 12) - whole
        return np.log((1 + whole) / (1 + part))
    if kind == 1:
        part = area(0, w, y_half, top)
    elif kind == 2:
        part = area(x_half, w, y, top)
    elif kind == 3:
        part = area(x_half, w, y, y_half) + area(0, x_half, y_half, top)
    elif kind == 4:
        part = area(0, w, y + h // 3, top - h // 3)
    else:
        part = area(w // 3, w - w // 3, y, top)
    return np.log((1 + part) / (1 + whole - part))


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """32-bit integers, one per frame that the filters fit."""
    c = chroma(samples, rate)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    codes = np.zeros(n, np.uint32)
    gray = np.array([0, 1, 3, 2], np.uint32)
    for kind, y, h, w in FILTERS:
        codes = codes << np.uint32(2) | gray[np.searchsorted(CUTS, _filter(image, kind, y, h, w, n))]
    return codes


def landmarks(codes: np.ndarray) -> list[int]:
    """The smallest hash in each stretch of frames, of the high bits of two codes some frames apart where they differ."""
    if not len(codes):
        return []
    high = ((codes >> np.uint32(1)) & np.uint32(0x55555555)).astype(np.uint64)
    gap = min(LANDMARK_GAP, len(high) - 1)
    first, second = high[: len(high) - gap], high[gap:]
    pair = first << np.uint64(32) | second
    changes = pair[first != second]
    pair = changes if len(changes) else pair
    h = (pair ^ pair >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(h, min(LANDMARK_WINDOW, len(h))).min(1)
    return np.unique(least).view(np.int64).tolist()


def offset_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often a code of ``a`` at i equals one of ``b`` at i + o, for o from 1 - len(a) to len(b) - 1.

    Equal codes are brought together by sorting. Codes that few frames hold are paired; the votes of one that many
    frames hold are a correlation of its places, so a steady tone takes time and memory in proportion to its length.
    """
    n = len(a) + len(b) - 1
    votes = np.zeros(n, np.int64)
    kinds, of = np.unique(np.concatenate((a, b)), return_inverse=True)
    places = []
    for codes in (of[: len(a)], of[len(a) :]):
        order = np.argsort(codes, kind="stable")
        places.append((order, np.searchsorted(codes[order], np.arange(len(kinds) + 1))))
    (in_a, at_a), (in_b, at_b) = places
    count_a, count_b = np.diff(at_a), np.diff(at_b)
    size = 1 << (n - 1).bit_length()
    often = count_a * count_b > 4 * size
    for k in np.flatnonzero(often):
        marks = []
        for order, at, length in ((in_a, at_a, len(a)), (in_b, at_b, len(b))):
            mark = np.zeros(length)
            mark[order[at[k] : at[k + 1]]] = 1
            marks.append(mark)
        votes += np.rint(np.fft.irfft(np.fft.rfft(marks[0][::-1], size) * np.fft.rfft(marks[1], size), size)[:n]).astype(np.int64)
    rest = np.flatnonzero((count_a > 0) & (count_b > 0) & ~often)
    ends = np.cumsum(count_a[rest] * count_b[rest])
    at = 0
    while at < len(rest):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, side="right")))
        some = rest[at:to]
        m = count_a[some] * count_b[some]
        kind = np.repeat(np.arange(len(some)), m)
        rank = np.arange(len(kind)) - np.repeat(np.cumsum(m) - m, m)
        i, j = np.divmod(rank, count_b[some][kind])
        votes += np.bincount(in_b[at_b[some][kind] + j] - in_a[at_a[some][kind] + i] + len(a) - 1, minlength=n)
        at = to
    return votes


def align(a: np.ndarray, b: np.ndarray, tries: int = 3) -> tuple[int, int, float, int] | None:
    """Offset of b against a, votes, bit error rate and overlap of the best of the most voted offsets; None without any."""
    if not len(a) or not len(b):
        return None
    votes = offset_votes(*((x >> np.uint32(1)) & np.uint32(0x55555555) for x in (a, b)))
    best = None
    for k in np.argsort(-votes, kind="stable")[:tries]:
        if not votes[k]:
            break
        o = int(k) - len(a) + 1
        x, y = a[max(0, -o) : len(b) - o], b[max(0, o) : len(a) + o]
        n = min(len(x), len(y))
        if n < max(LEAST_FRAMES, LEAST_OVERLAP * min(len(a), len(b))):
            continue
        errors = float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n)
        if best is None or (errors, o) < (best[2], best[0]):
            best = (o, int(votes[k]), errors, n)
    return best


def fingerprints(recordings: DataFrame, *, media: str = "media", key: str = "rec_id") -> DataFrame:
    """rec_id, n_codes, codes (packed little-endian), code_key, marks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column("media").to_pylist():
                wav = read_wav(raw)
                found.append(fingerprint(*wav) if wav else np.zeros(0, np.uint32))
            packed = [c.astype("<u4").tobytes() for c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rec_id"), pa.array(map(len, found), pa.int32()), pa.array(packed, pa.binary()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array([landmarks(c) for c in found], pa.list_(pa.int64()))],
                names=["rec_id", "n_codes", "codes", "code_key", "marks"],
            )
        release()

    text_batches(recordings.sparkSession)
    schema = "rec_id long, n_codes int, codes binary, code_key string, marks array<long>"
    return recordings.select(F.col(key).cast("long").alias("rec_id"), F.col(media).cast("binary").alias("media")).mapInArrow(work, schema)


def search(found: DataFrame, is_query) -> tuple[DataFrame, DataFrame]:
    """(classes: code_key, class_id, rec_id, members, has_query; matches: query_class, class_id, offset, votes, error, overlap).

    A class's number is its smallest rec_id; of classes that share theirs, as one id has several recordings, all but one
    get numbers of their own.
    """
    grouped = found.filter("n_codes > 0 AND rec_id IS NOT NULL").groupBy("code_key").agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("members"), F.max(is_query).alias("has_query"))
    place = F.row_number().over(Window.partitionBy("rec_id").orderBy("code_key"))
    own = F.when(place == 1, F.col("rec_id")).otherwise(F.lit(-(1 << 62)) + F.pmod(F.xxhash64("code_key"), F.lit(1 << 61)))
    classes = keep(grouped.withColumn("class_id", own))
    of = found.select(F.col("rec_id").alias("holder"), "code_key", "codes", "marks").join(classes.select("rec_id", "code_key", "class_id", "has_query"), "code_key")
    reps = keep(of.filter("holder = rec_id").dropDuplicates(["code_key"]).drop("rec_id").withColumnRenamed("class_id", "rec_id"))
    marks = reps.select(F.col("rec_id").alias("class_id"), "has_query", F.explode("marks").alias("mark"))
    queries = marks.filter("has_query").select(F.col("class_id").alias("query_class"), "mark")
    salts = marks.groupBy("mark").agg(F.ceil(F.count("*") / MARK_CLASSES).alias("salts"), F.max("has_query").alias("asked")).filter("asked").select("mark", "salts")
    asked = queries.join(salts, "mark").select("query_class", "mark", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    held = marks.join(salts, "mark").select("class_id", "mark", F.pmod(F.xxhash64("class_id"), "salts").alias("salt"))
    pairs = asked.join(held, ["mark", "salt"]).filter("query_class <> class_id").select("query_class", "class_id").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, c, x, y in zip(*(batch.column(n).to_pylist() for n in ("query_class", "class_id", "qc", "cc")), strict=True):
                best = align(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"))
                if best and best[2] <= MOST_ERRORS:
                    rows.append((q, c, *best))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=["query_class", "class_id", "offset", "votes", "error", "overlap"])

    codes = reps.select("rec_id", "codes")
    left = pairs.join(codes.select(F.col("rec_id").alias("query_class"), F.col("codes").alias("qc")), "query_class")
    both = left.join(codes.select(F.col("rec_id").alias("class_id"), F.col("codes").alias("cc")), "class_id")
    schema = "query_class long, class_id long, offset int, votes int, error double, overlap int"
    return classes, both.select("query_class", "class_id", "qc", "cc").mapInArrow(work, schema)


RATE, STEP_SECONDS, LEAD_STEPS = 4000, 0.2, 5
#: Recordings that are rendered together, some 26 kB each.
RENDER_ROWS = 128


def tones(vector: np.ndarray, lead: int) -> np.ndarray:
    """A vector as sound: each four numbers are the loudness of four pitches for a fifth of a second, after ``lead`` hops of silence."""
    step = int(STEP_SECONDS * RATE)
    steps = np.resize(vector, -(-len(vector) // 4) * 4).reshape(-1, 4)
    t = np.arange(step) / RATE
    pitches = np.stack([np.sin(2 * np.pi * 440 * 2 ** (p / 12) * t) for p in range(12)])
    loud = np.zeros((len(steps), 12))
    for k in range(len(steps)):
        loud[k, (3 * np.arange(4) + k) % 12] = np.exp(4 * np.clip(steps[k], -0.6, 0.6))
    sound = (loud @ pitches).ravel()
    return np.concatenate((np.zeros(round(lead * HOP_SECONDS * RATE)), sound / max(1e-9, np.abs(sound).max()) * 0.9))


def render(vectors: DataFrame) -> DataFrame:
    """rec_id, media: each row of ``embeddings`` as a WAV recording; rows start after differing silences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), RENDER_ROWS):
                batch = whole.slice(at, RENDER_ROWS)
                ids = batch.column("vec_id").to_pylist()
                made = [write_wav(tones(np.array(v, float), (i or 0) % LEAD_STEPS), RATE) if v else None for i, v in zip(ids, batch.column("embedding").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.binary())], names=["rec_id", "media"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(work, "rec_id long, media binary")


def op1_audio_fingerprint(spark, sf_dir: str) -> DataFrame:
    """One row per recording: its fingerprint's digest and class, and how many query recordings' classes align with it.

    Queries are the recordings whose id is divisible by 20; all recordings are searched.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = settle(fingerprints(render(vectors)))
    classes, matches = search(found, F.col("rec_id") % 20 == 0)
    best = F.min(F.struct("error", "query_id", "offset"))
    matches = matches.join(classes.select(F.col("class_id").alias("query_class"), F.col("rec_id").alias("query_id")), "query_class")
    links = matches.groupBy("class_id").agg(F.count("*").alias("n_links"), best.alias("best"))
    of_class = classes.join(links, "class_id", "left").select("code_key", F.col("rec_id").alias("class_rec"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "best")
    joined = found.join(of_class, "code_key", "left")
    return joined.select(
        F.col("rec_id").alias("vec_id"), F.col("n_codes").cast("long").alias("n_codes"), F.col("code_key").alias("codes_sha256"),
        F.coalesce("class_rec", "rec_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("best.query_id").alias("best_query"), F.col("best.offset").cast("long").alias("best_offset"), F.col("best.error").alias("best_error"),
    )
