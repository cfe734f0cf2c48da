"""Registered queries of the corpus-preparation package against SQL, and the pipeline against a version in SQL and Python."""

import datetime
import decimal
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hanji.llm import packing, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def connect():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = connect().execute(registry.ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert got == sorted(tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_a_row_per_input_row(spark, name):
    tables = {"op1_audio_fingerprint": "embeddings", "op9_url_filter": "pages", "op10_html_extract": "pages"}
    rows = registry.QUERIES[name](spark, SF).toPandas()
    n = spark.read.parquet(f"{SF}/{tables.get(name, 'documents')}.parquet").count()
    key = rows.columns[0]
    assert rows[key].nunique() == n


def test_pipeline_equals_brute_force(spark):
    con = connect()
    con.execute("CREATE TABLE d1 AS SELECT * FROM documents WHERE regexp_matches(coalesce(text, ''), '\\p{L}')")
    over = lambda sql, name: sql.replace("FROM documents", f"FROM {name}")
    con.execute(f"CREATE TABLE q AS {over(registry.ORACLES['op5_quality_cascade'], 'd1')}")
    con.execute("CREATE TABLE d2 AS SELECT * FROM d1 WHERE doc_id IN (SELECT doc_id FROM q WHERE kept)")
    con.execute(f"CREATE TABLE n AS {over(registry.ORACLES['op6_minhash_dedup'], 'd2')}")
    con.execute("CREATE TABLE d3 AS SELECT * FROM d2 WHERE doc_id IN (SELECT doc_id FROM n WHERE kept)")
    con.execute(f"CREATE TABLE m AS {over(registry.ORACLES['op4_mix_sources'], 'd3')}")
    copies = Counter()
    for doc_id, size, taken in con.execute("SELECT doc_id, size, taken FROM m").fetchall():
        copies[doc_id] = taken // size
    texts = dict(con.execute("SELECT doc_id, text FROM d3").fetchall())
    tokenizer = packing._tokenizer(packing.default_vocabulary())
    want = Counter()
    for doc_id, k in copies.items():
        n = len(tokenizer.encode(texts[doc_id], add_special_tokens=False).ids) + 1
        for piece, start in enumerate(range(0, n, packing.CAPACITY)):
            if k:
                want[doc_id, piece, start, min(packing.CAPACITY, n - start)] += k
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= packing.CAPACITY
    lengths = np.array([r["length"] for r in rows])
    assert len(by_sequence) <= packing.lower_bound(lengths) + 2


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_duplicate_stage_keeps_one_of_an_original_and_its_copies(spark):
    """Copies of similarity 0.78 to 0.82 with their original, far from one another."""
    rng, words = random.Random(12), 400
    base = [f"w{i}" for i in range(words)]
    rows = []
    for k in range(301):
        own = list(base)
        for place in rng.sample(range(4, words - 4, 5), 0 if k == 150 else rng.choice([8, 9])):
            own[place] = f"x{k}p{place}"
        rows.append((k, " ".join(own), "en", "a", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [0]


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    """Repeated rows, rows without id and rows that share one; extra columns that operators name so themselves."""
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, text, "c"), (None, "own " + text[::-1], "d"), (None, "own " + text[::-1], "d"), (3, None, "e"), (4, "", "f"), (5, "one two three four five", "y"), (5, "one two three four five", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("rows", F.lit(1)).withColumn("row", F.lit(2))
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["kept"]) for r in got.collect()), key=str) == sorted([(1, "a"), (None, "d"), (3, "e"), (4, "f"), (5, "x")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_language_stage_rejects_texts_of_no_language(spark, monkeypatch):
    words = {"en": "the cat and the dog are in the house ", "de": "der hund und die katze sind nicht zuhause ", "ru": "это был хороший день и мы пошли домой "}
    rows = [(i, w * 8, lang, "x") for i, (lang, w) in enumerate(words.items())] + [(7, "".join(w * 8 for w in words.values()), None, "x"), (8, "12 !", "en", "x"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()} == {0, 1, 2}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("de", "ru"))
    got = corpus_pipeline.language(spark, docs, SF)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == {1, 2}


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"wort{i} und the {i % 7}" for i in range(9000))
    rows = [(None, None, None, None, None), (1, "", None, "a", 0), (2, long, "en", None, 1), (3, long, "en", "a", 1), (4, "123 456", "en", "a", 1)]
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in got} <= {2, 3}
