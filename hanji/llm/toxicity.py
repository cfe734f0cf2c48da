"""Toxicity by a convolutional text classifier (operator 7), trained in numpy.

A word is a run of letters; its embedding is the sum of hashed embeddings of the lower-cased word and of its prefixes and
suffix, so that inflected and compound forms share evidence. Filters of width 1, 2 and 3 slide over the words, each
is max-pooled over the whole text, and a logistic layer reads the maxima. Thresholds are calibrated by language on
training rows that fitting left out; the language is predicted from the text (hashed word counts), never read. The
score is the calibrated logistic value, so that 0.5 is each language's threshold.

Fitting uses a bounded sample of labelled rows (:data:`TRAIN_PER_LABEL` whole texts a label); scoring covers every row
and whole texts, in blocks of bounded size.

Defined cases: null and letterless texts get the score of a text without words; null labels are not learned from;
without labels of both kinds every score is 0; repeated rows score alike; an empty table gives an empty result; extra
columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanji.llm.common import held_out, release, text_batches
from hanji.llm.lang_id import pieces, tables

TRAIN_PER_LABEL = 2500
BITS, DIM, FILTERS, WIDTHS = 17, 12, 10, (1, 2, 3)
PIECE_CHARS = 400_000
EPOCHS, BATCH, RATE = 14, 64, 0.02
#: Training texts that must hold a word or part before it gets an embedding; rarer ones stay at zero.
MIN_TEXTS = 3
#: Lengths of the prefixes, and of the suffix, that are embedded besides the word.
PARTS = ("word", 4, 6, -4)
_MASK = (1 << BITS) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt * 0x94D049BB133111EB & (1 << 64) - 1)
    return ((h ^ h >> np.uint64(29)) & np.uint64(_MASK)).astype(np.int64)


def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, parts) bucket numbers and the text that each word is in. Bucket 0 stands for an absent part."""
    lower, letter, _ = tables()
    joined = "\n".join(texts) + "\n"
    chars = lower[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = np.diff(letter[chars].view(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.searchsorted(np.concatenate(([0], np.cumsum(lengths))), first, side="right") - 1
    size = 1 << int(len(chars)).bit_length()
    up, down = _powers(size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(chars.astype(np.uint64) * up[: len(chars)], dtype=np.uint64)))
    span = lambda a, b: (sums[b] - sums[a]) * down[a]
    length = last - first
    out = np.zeros((len(first), len(PARTS)), np.int64)
    for k, part in enumerate(PARTS):
        if part == "word":
            out[:, k] = _mix(span(first, last), 1)
        elif part > 0:
            out[:, k] = np.where(length > part, _mix(span(first, first + np.minimum(part, length)), part + 1), 0)
        else:
            out[:, k] = np.where(length > -part, _mix(span(last + np.maximum(part, -length), last), 1 - part * 100), 0)
    return out, owner


@dataclass
class Net:
    """Weights; ``embed`` row 0 is zero. ``shift``: per language, the logit where the score is 0.5."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    langs: np.ndarray
    shift: np.ndarray
    slope: float = 1.0

    def pooled(self, words: np.ndarray, owner: np.ndarray, n: int, where: bool = False):
        """(texts, filters) maxima after the rectifier; with ``where``, also the words at which they stand."""
        if not len(owner):
            empty = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
            return (empty, np.full(empty.shape, -1)) if where else empty
        x = self.embed[words[:, 0]]
        for k in range(1, words.shape[1]):
            x += self.embed[words[:, k]]
        present, starts = np.unique(owner, return_index=True)
        end_of = np.concatenate((starts[1:], [len(owner)]))
        room = np.repeat(end_of, np.diff(np.concatenate((starts, [len(owner)])))) - np.arange(len(owner))
        maxima, at = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), np.full((n, FILTERS * len(WIDTHS)), -1)
        for i, (width, w) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            y = x @ w[0]
            for j in range(1, width):
                y[:-j] += np.where((room[:-j] > j)[:, None], x[j:] @ w[j], 0)
            y += self.bias[i]
            np.maximum(y, 0, out=y)
            block = slice(i * FILTERS, (i + 1) * FILTERS)
            if len(starts):
                maxima[present, block] = np.maximum.reduceat(y, starts, axis=0)
            if where:
                for d, a, b in zip(present, starts, end_of, strict=True):
                    at[d, block] = a + y[a:b].argmax(0)
        return (maxima, at) if where else maxima

    def logits(self, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return self.pooled(words, owner, n) @ self.out + self.out_bias

    def language(self, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros((n, self.langs.shape[1]))
        present, starts = np.unique(owner, return_index=True)
        if len(starts) and total.shape[1]:
            total[present] = np.add.reduceat(self.langs[words[:, 0]], starts, axis=0)
        return total.argmax(1) if total.shape[1] else np.zeros(n, int)

    def scores(self, texts: list[str]) -> np.ndarray:
        words, owner = word_features(texts)
        n = len(texts)
        z = self.logits(words, owner, n)
        lang = self.language(words, owner, n)
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.shift[lang]), -30, 30)))


def _language_table(words, owner, langs: list[str | None]) -> tuple[np.ndarray, list[str]]:
    names = sorted({x for x in langs if x})
    counts = np.full((1 << BITS, len(names)), 0.1)
    index = np.array([names.index(x) if x else -1 for x in langs] or [0])
    for k in range(len(names)):
        counts[:, k] += np.bincount(words[index[owner] == k, 0], minlength=1 << BITS)
    return (np.log(counts / counts.sum(0)).astype(np.float32) if names else np.zeros((1 << BITS, 0), np.float32)), names


def train(rows: list[tuple[str, int, str | None]], seed: int = 7) -> Net | None:
    """``rows``: text, label, language. Every fifth row is left out of fitting, for early stopping and calibration."""
    if len({y for _, y, _ in rows}) < 2:
        return None
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    parts, owners, done = [], [], 0
    for piece in pieces([t for t, _, _ in rows], PIECE_CHARS):
        w, o = word_features(piece)
        parts.append(w)
        owners.append(o + done)
        done += len(piece)
    words, owner = np.concatenate(parts), np.concatenate(owners)
    y = np.array([label for _, label, _ in rows], np.float32)
    table, names = _language_table(words, owner, [x for _, _, x in rows])
    inside = np.arange(len(rows)) % 5 != 4
    for k in range(words.shape[1]):
        pairs = np.unique(words[:, k] * len(rows) + owner)
        pairs = pairs[inside[pairs % len(rows)]]
        frequent = np.bincount(pairs // len(rows), minlength=1 << BITS) >= MIN_TEXTS
        words[:, k] = np.where(frequent[words[:, k]], words[:, k], 0)
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
    embed = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    known = np.zeros(1 << BITS, bool)
    known[words.ravel()] = True
    known[0] = False
    embed[~known] = 0
    net = Net(
        embed, [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros((len(WIDTHS), FILTERS), np.float32),
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), float(np.log(y.mean() / (1 - y.mean()))), table, np.zeros(max(1, len(names))),
    )

    def some(ids):
        take = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in ids])
        return words[take], np.repeat(np.arange(len(ids)), bounds[np.array(ids) + 1] - bounds[ids])

    fit_ids, out_ids = np.flatnonzero(inside), np.flatnonzero(~inside)
    blocks = [out_ids[i : i + 200] for i in range(0, len(out_ids), 200)]
    held_logits = lambda: np.concatenate([net.logits(*some(b), len(b)) for b in blocks]) if len(out_ids) else np.zeros(0)
    params = [net.embed, *net.filters, net.bias, net.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    best, step = None, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(fit_ids)
        for i in range(0, len(order), BATCH):
            ids = order[i : i + BATCH]
            w, o = some(ids)
            pooled, at = net.pooled(w, o, len(ids), where=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
            dz = ((p - y[ids]) / len(ids)).astype(np.float32)
            active = (pooled > 0) & (at >= 0)
            g_pool = dz[:, None] * net.out[None] * active
            g_embed_at, g_embed, g_filters, g_bias = [], [], [np.zeros_like(f) for f in net.filters], np.zeros_like(net.bias)
            ends = np.searchsorted(o, np.arange(len(ids)), side="right")
            for k, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                d, c = np.nonzero(active[:, k * FILTERS : (k + 1) * FILTERS])
                g, pos = g_pool[d, k * FILTERS + c], at[d, k * FILTERS + c]
                np.add.at(g_bias[k], c, g)
                for j in range(width):
                    ok = pos + j < ends[d]
                    rows_at = w[pos[ok] + j]
                    vec = net.embed[rows_at].sum(1)
                    gf = np.zeros((FILTERS, DIM), np.float32)
                    np.add.at(gf, c[ok], g[ok, None] * vec)
                    g_filters[k][j] += gf.T
                    ge = g[ok, None] * f[j][:, c[ok]].T
                    g_embed_at.append(rows_at.ravel())
                    g_embed.append(np.repeat(ge, w.shape[1], axis=0))
            g_out = (pooled * dz[:, None]).sum(0) + 1e-4 * net.out
            step += 1
            net.out_bias -= RATE * float(dz.sum())
            scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p_, g_, (m, v) in zip(params[1:], [*g_filters, g_bias, g_out], moments[1:], strict=True):
                m *= 0.9
                m += 0.1 * g_
                v *= 0.999
                v += 0.001 * g_ * g_
                p_ -= scale * 0.3 * m / (np.sqrt(v) + 1e-8)
            if g_embed_at:
                index, inverse = np.unique(np.concatenate(g_embed_at), return_inverse=True)
                total = np.zeros((len(index), DIM), np.float32)
                np.add.at(total, inverse, np.concatenate(g_embed))
                total[index == 0] = 0
                m, v = moments[0]
                m[index] = 0.9 * m[index] + 0.1 * total
                v[index] = 0.999 * v[index] + 0.001 * total * total
                net.embed[index] -= scale * m[index] / (np.sqrt(v[index]) + 1e-8)
                net.embed[0] = 0
        z = held_logits()
        if len(z):
            loss = float(np.mean(np.logaddexp(0, np.where(y[out_ids] > 0, -z, z))))
            if best is None or loss < best[0]:
                best = (loss, [p.copy() for p in params], net.out_bias)
    if best is not None:
        for p_, kept in zip(params, best[1], strict=True):
            p_[...] = kept
        net.out_bias = best[2]
    calibrate(net, [rows[i] for i in out_ids], held_logits())
    return net


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that splits best by F1; among equals, the middle of the widest gap around it."""
    order = np.argsort(-z, kind="stable")
    zs, hit = z[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(zs) + 1) + y.sum())
    gap = zs - np.append(zs[1:], zs[-1] - 1.0)
    i = max(range(len(zs)), key=lambda k: (round(float(f1[k]), 6), gap[k]))
    return float(zs[i] - gap[i] / 2)


def calibrate(net: Net, rows: list[tuple[str, int, str | None]], z: np.ndarray, least: int = 8) -> None:
    """Thresholds by predicted language, where at least ``least`` rows of each label were left out; else the common one."""
    y = np.array([label for _, label, _ in rows], float)
    if not len(y) or y.min() == y.max():
        return
    common = best_cut(z, y)
    net.shift[:] = common
    words, owner = word_features([t for t, _, _ in rows])
    lang = net.language(words, owner, len(rows))
    for k in range(len(net.shift)):
        own = lang == k
        if min(y[own].sum(), (1 - y[own]).sum()) >= least:
            net.shift[k] = best_cut(z[own], y[own])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, per_label: int = TRAIN_PER_LABEL) -> Net | None:
    """Model from at most ``per_label`` whole texts of each label, those with the smallest id hashes.

    The ids are chosen on the labels alone and number at most ``2 * per_label``, which bounds the broadcast and the read.
    An id with both labels counts as toxic, and of an id's texts the smallest is read, so that repeated rows neither
    change the model nor grow what the driver gets.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(usable)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("_h", F.xxhash64("doc_id"))
    chosen = [r for y in (0, 1) for r in known.filter(F.col("toxic") == y).orderBy("_h", "doc_id").limit(per_label).collect()]
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int")
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    got = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.text", "toxic", "row.lang").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([(r["text"] or "", r["toxic"], r["lang"]) for r in got])


def score(docs: DataFrame, net: Net | None, *, keep=("doc_id",)) -> DataFrame:
    """``keep`` and score."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)
    chosen = docs.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([*[f for f in chosen.schema.fields if f.name != "_text"], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            found = [held.value.scores(p) if held.value else np.zeros(len(p)) for p in pieces(texts, PIECE_CHARS)]
            values = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            arrays = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*arrays, values], names=[f.name for f in schema.fields])
        release()

    return chosen.mapInArrow(work, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 5, 0))
    scored = score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
