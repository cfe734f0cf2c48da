"""Collocations: suffix arrays and counts against plain counting, the whole query against a model."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hanji.llm import collocations as co


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.integers(1, 9))
def test_suffix_array_equals_sorting(ids, depth):
    s = np.array([*ids, 0], np.int64)
    order, common = co.suffix_array(s, depth)
    # Past the end of the array stand ends of pieces.
    suffix = [tuple([*s.tolist(), *[0] * depth][i : i + depth]) for i in range(len(s))]
    assert [suffix[i] for i in order] == sorted(suffix)
    assert sorted(order.tolist()) == list(range(len(s)))
    for j in range(1, len(s)):
        a, b, n = int(order[j - 1]), int(order[j]), int(common[j])
        same = next((k for k in range(depth) if suffix[a][k] != suffix[b][k]), depth)
        # The end of the array may cut a common prefix short, but never within a piece.
        assert n == same or n < same and 0 in suffix[a][:same]


def plain_grams(s, n):
    out = Counter()
    for i in range(len(s) - n + 1):
        if 0 not in (w := tuple(s[i : i + n])):
            out[w] += 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.sets(st.tuples(st.integers(1, 4), st.integers(1, 4))))
def test_grams_and_chains_equal_counting(ids, rare):
    s = np.array([0, *ids, 0], np.int64)
    for n, places, counts in co.grams(s, 1, 5):
        assert {tuple(s[p : p + n].tolist()): c for p, c in zip(places, counts.tolist(), strict=True)} == plain_grams(s.tolist(), n)
    cut = co.chains(s, lambda places: np.array([(int(s[p]), int(s[p + 1])) not in rare for p in places], bool))
    for n in (3, 4, 5):
        want = {w: c for w, c in plain_grams(s.tolist(), n).items() if not any(pair in rare for pair in zip(w, w[1:], strict=False))}
        assert plain_grams(cut.tolist(), n) == want


def model(rows, least=100, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        longer = [(" " + " ".join(q) + " ", len(q), c) for q, c in often.items()]
        rows = []
        for p, a in often.items():
            if any(m > len(p) and 100 * c >= 100 * a and " " + " ".join(p) + " " in q for q, m, c in longer):
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), lang, a, counts[p[:k]], counts[p[k:]], total[lang], score))
        for rank, (_, _, phrase, lang, a, left, right, n, score) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n, score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = [*"abcdefgh", "Über", "ünï", "漢字", "x y", "\x1c", "I", "i"]
    made = []
    for _ in range(n):
        made.append("".join(rng.choice(["A b c d e f", "the same words again", rng.choice(words), rng.choice(words), "of the"]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "?", "\r\n"]) for _ in range(rng.randrange(60))))
    return made


ODD = [(None, None), ("en", None), ("en", ""), ("en", " \t.,\n"), ("und", "a b c"), (None, "a b c")]


@pytest.mark.parametrize(("bits", "shard", "least", "top"), [(co.FILTER_BITS, 500, 12, 2000), (64, 1 << 20, 5, 7), (1 << 12, 90, 25, 2000)])
def test_phrases_equal_model(spark, bits, shard, least, top, monkeypatch):
    """Small shards, and tables of bits so full that all pairs pass; parts smaller than the number kept."""
    rows = [(lang, t) for k, lang in enumerate(("en", "de", None)) for t in texts(k, 70)] + ODD * 3 + [("en", "of the " * 4000), ("xx", "y" * 9000)]
    docs = spark.createDataFrame([(i % 5 or None, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("phrase", "n", "f", "part", "rank", "total")})
    monkeypatch.setattr(co, "STRETCH", 700)
    got = co.collocations(docs.repartition(3), least=least, top=top, shard_bytes=shard, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == model(rows, least, top)
    assert co.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, left, right = 3_000_000_019, 900_000_000_000_007, 5_000_000_029, 4_000_000_007
    found = spark.createDataFrame([("en", "p q", 2, a), ("en", "p", 1, left), ("en", "q", 1, right)], co.COUNTS)
    row = co.scored(found, spark.createDataFrame([("en", n)], "lang string, total long")).first()
    assert (row["score"], row["l"], row["r"]) == (1000 * a * n // (left * right), left, right)


def test_stretches_lose_no_piece(monkeypatch):
    monkeypatch.setattr(co, "STRETCH", 10)
    text = b"Aa bb. cc, dd ee ff gg hh ii jj kk; ll\nMM" * 9 + b" " + b"n" * 50
    assert b".".join(co.stretches(text)) == text.translate(co._TABLE)
