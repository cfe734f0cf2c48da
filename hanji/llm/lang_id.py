"""Language identification (operator 3): script ranges, per-word scores and a Viterbi path over languages.

A word is a maximal run of letters and marks that holds a letter. The script of its letters narrows the candidate languages to those that training
saw written in it; each candidate scores the word by hashed character bigrams and trigrams (log-likelihood, bounded per
word); a Viterbi path with a penalty for every change of language then labels the words, so that spans of another
language inside a text come out and single odd words do not. All work is done on arrays over many texts at a time; the
path advances all texts of a block by one word per step, texts that have ended dropping out.

Fitting uses a bounded sample of labelled texts (about :data:`TRAIN_PER_LANGUAGE` whole texts a language); everything else
covers every row and whole texts. Only text and, in fitting, ``lang`` are read.

Defined cases: null or letterless text is ``und`` with score 0 and no spans; null ``lang`` is not learned from; ties go
to the language that sorts first; repeated rows are labelled alike; without any learnable row all texts are ``und``; an
empty table gives an empty result; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanji.llm.common import held_out, release, text_batches

TRAIN_PER_LANGUAGE = 1000
BITS = 16
SWITCH = 12.0
#: Most that one word may speak for one language over another.
WORD_BOUND = 6.0
#: Bytes of texts whose paths are found together, and code points that are scored together; a longer text stands alone.
BLOCK_CHARS, PIECE_CHARS = 6_000_000, 500_000
#: A script counts for a language that writes at least this share of its letters in it.
SCRIPT_SHARE = 0.01

#: First code points of script ranges and the scripts, fixed by Unicode; between ranges, "other".
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its lower case (one code point), whether it is a letter, and whether it belongs to words.

    Marks (accents, vowel signs) belong to words, but only letters make one.
    """
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letter, inside = np.zeros(len(lower), bool), np.zeros(len(lower), bool)
    for c in range(len(lower)):
        char = chr(c)
        if char.isalpha():
            letter[c] = inside[c] = True
            low = char.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif c < 0x20000:
            inside[c] = unicodedata.category(char)[0] == "M"
    return lower, letter, inside


def _script_ids(chars: np.ndarray) -> np.ndarray:
    names = sorted({s for _, s in SCRIPTS})
    ids = np.array([names.index(s) for _, s in SCRIPTS])
    at = np.searchsorted(np.array([c for c, _ in SCRIPTS]), chars, side="right") - 1
    return np.where(at >= 0, ids[np.maximum(at, 0)], names.index("other"))


N_SCRIPTS = len({s for _, s in SCRIPTS})


@dataclass
class Words:
    """Words of a block of texts: the text each belongs to, where it starts and ends there, script and hash positions."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray
    grams: np.ndarray


def split_words(texts: list[str]) -> Words:
    lower, letter, inside = tables()
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    joined = "\n".join(texts) + "\n"
    chars = lower[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    in_word, letters = inside[chars], letter[chars]
    edge = np.diff(in_word.view(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(first) and not (in_word == letters).all():
        some = np.logical_or.reduceat(letters, first)
        first, last = first[some], last[some]
    chars = np.where(in_word, chars, np.uint32(32))
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    owner = np.searchsorted(offsets, first, side="right") - 1
    before = np.concatenate(([np.uint32(32)], chars[:-1]))
    after = np.concatenate((chars[1:], [np.uint32(32)]))
    two = (before * np.uint32(0x9E3779B1)) ^ (chars * np.uint32(0x85EBCA6B))
    three = two * np.uint32(0xC2B2AE35) + after * np.uint32(0x27D4EB2F)
    grams = np.stack((two * np.uint32(0x2C1B3C6D) >> np.uint32(33 - BITS), (three ^ three >> np.uint32(15)) * np.uint32(0x297A2D39) >> np.uint32(33 - BITS)), 1)
    grams[:, 1] += np.uint32(1 << BITS - 1)
    return Words(owner.astype(np.int32), (first - offsets[owner]).astype(np.int32), (last - offsets[owner]).astype(np.int32), _script_ids(chars[first]), first, grams)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model | None:
        langs = sorted({lang for lang, _ in rows})
        if not langs:
            return None
        counts, scripts = np.full((1 << BITS, len(langs)), 0.5), np.zeros((N_SCRIPTS, len(langs)))
        for k, lang in enumerate(langs):
            for piece in pieces([t for x, t in rows if x == lang and t], PIECE_CHARS):
                w = split_words(piece)
                inside = np.zeros(len(w.grams) + 1, np.int8)
                np.add.at(inside, w.first, 1)
                ends = w.first + (w.end - w.start)
                np.add.at(inside, ends, -1)
                used = w.grams[np.cumsum(inside[:-1]).astype(bool)].ravel()
                counts[:, k] += np.bincount(used, minlength=1 << BITS)
                scripts[:, k] += np.bincount(w.script, weights=w.end - w.start, minlength=N_SCRIPTS)
        half = 1 << BITS - 1
        table = np.concatenate([np.log(part / part.sum(0)) for part in (counts[:half], counts[half:])])
        share = scripts / np.maximum(scripts.sum(0), 1)
        return cls(langs, table.astype(np.float32), share >= SCRIPT_SHARE)

    def word_scores(self, w: Words) -> np.ndarray:
        """(words, languages): bounded log-likelihoods; candidates of other scripts get the bound."""
        if not len(w.first):
            return np.zeros((0, len(self.langs)), np.float32)
        each = self.table[w.grams[:, 0]]
        each += self.table[w.grams[:, 1]]
        stops = np.stack((w.first, w.first + (w.end - w.start)), 1).ravel()
        total = np.add.reduceat(each, stops[:-1] if stops[-1] >= len(each) else stops, axis=0)[::2]
        fits = self.scripts[w.script]
        total = np.where(fits | ~fits.any(1, keepdims=True), total, -np.inf)
        top = total.max(1, keepdims=True)
        return np.maximum(total - top, -WORD_BOUND).astype(np.float32)


def pieces(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Whole texts together, up to ``limit`` code points; a longer text stands alone."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > limit:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. ``counts``: words of each text, whose words follow one another in ``scores``."""
    kind = np.min_scalar_type(max(1, scores.shape[1] - 1))
    path = np.zeros(len(scores), kind)
    if not len(scores):
        return path
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    alive = len(counts) - np.searchsorted(counts[::-1], np.arange(1, counts[0] + 1), side="left")
    from_best, best_before = np.zeros(scores.shape, bool), np.zeros(len(scores), kind)
    now = scores[starts[: alive[0]]].copy()
    ended = np.zeros(len(counts), np.int64)
    rows = np.arange(len(counts))
    for t in range(1, counts[0]):
        n, was = alive[t], len(now)
        if n < was:
            ended[n:was] = now[n:].argmax(1)
            now = now[:n]
        at = starts[:n] + t
        top = now.argmax(1)
        moved = now[rows[:n], top] - switch
        jump = moved[:, None] > now
        from_best[at], best_before[at] = jump, top
        now = np.where(jump, moved[:, None], now) + scores[at]
    ended[: len(now)] = now.argmax(1)
    state = ended
    for t in range(counts[0] - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = np.where(from_best[at, state[:n]], best_before[at], state[:n])
    return path


def label_block(model: Model | None, texts: list[str], spans: bool) -> tuple[list[str], np.ndarray, list]:
    n = len(texts)
    langs, share, found = ["und"] * n, np.zeros(n), [[] for _ in range(n)] if spans else []
    if model is None or not n:
        return langs, share, found
    owner, start, end, scores, done = [], [], [], [], 0
    for piece in pieces(texts, PIECE_CHARS):
        w = split_words(piece)
        owner.append(w.text + np.int32(done))
        start.append(w.start)
        end.append(w.end)
        scores.append(model.word_scores(w))
        done += len(piece)
    owner, start, end, scores = (np.concatenate(x) for x in (owner, start, end, scores))
    path = viterbi(scores, np.bincount(owner, minlength=n)[np.unique(owner)] if len(owner) else np.zeros(0, np.int64))
    k = len(model.langs)
    letters = np.bincount(owner.astype(np.int64) * k + path, weights=end - start, minlength=n * k).reshape(n, k) if len(owner) else np.zeros((n, k))
    total = letters.sum(1)
    best = letters.argmax(1)
    share = np.where(total > 0, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)
    langs = [model.langs[b] if s else "und" for b, s in zip(best, total, strict=True)]
    if spans and len(owner):
        change = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
        stop = np.concatenate((change[1:], [len(owner)])) - 1
        for a, b in zip(change, stop, strict=True):
            found[owner[a]].append({"start": int(start[a]), "end": int(end[b]), "lang": model.langs[path[a]]})
    return langs, share, found


def fit(docs: DataFrame, usable: Column, *, per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """Model from about ``per_language`` distinct whole texts a language, at most that many times the languages in all.

    The number of distinct texts of a language gives the share of text hashes that are low enough; the texts come to the
    driver in one bounded read. Should that read be full, all languages lose the same share.
    """
    hashed = F.xxhash64("text")
    keyed = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", hashed.alias("_x"))
    counts = keyed.groupBy("lang").agg(F.approx_count_distinct("_x").alias("texts")).collect()
    if not counts:
        return None
    unit = F.pmod("_x", F.lit(1 << 30))
    shares = [(F.lit(c["lang"]), F.lit(-(-(per_language << 30) // max(1, c["texts"]))).cast("long")) for c in counts]
    limit = F.element_at(F.create_map(*[v for pair in shares for v in pair]), F.col("lang"))
    low = keyed.withColumns({"_h": unit, "_limit": limit}).filter("_h < _limit").groupBy("lang", "_x").agg(F.min("text").alias("text"), F.min(F.col("_h") / F.col("_limit")).alias("_at"))
    few = low.orderBy("_at", "lang", "text").limit(per_language * len(counts))
    return Model.fit([(r["lang"], r["text"]) for r in few.collect()])


SPANS = "array<struct<start:int,end:int,lang:string>>"


def detect(docs: DataFrame, model: Model | None, *, keep=("doc_id",), spans: bool = False, keep_text: bool = False) -> DataFrame:
    """``keep`` (and text), lang_pred, score (share of the letters that the label covers) and, if asked, the labelled spans."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*keep, F.col("text").alias("_text"))
    fields = [f for f in chosen.schema.fields if f.name != "_text"]
    if keep_text:
        fields.append(T.StructField("text", T.StringType()))
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if spans:
        schema = schema.add("spans", T._parse_datatype_string(SPANS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held_batches):
            table = pa.Table.from_batches(held_batches)
            texts = [t or "" for t in table.column("_text").to_pylist()]
            langs, share, found = label_block(held.value, texts, spans)
            table = table.rename_columns([*table.column_names[:-1], "text"])
            out = (table if keep_text else table.drop_columns(["text"])).append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(share, pa.float64()))
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                out = out.append_column("spans", pa.array(found or [[]] * len(texts), kind))
            return out.to_batches()

        waiting, size = [], 0
        for batch in batches:
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + BLOCK_CHARS - size, side="right")))
                waiting.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= BLOCK_CHARS or at < len(batch):
                    yield from flush(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from flush(waiting)
        release()

    return chosen.mapInArrow(work, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out("doc_id", 4, 2))
    return detect(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
