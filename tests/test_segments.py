"""The segmented index against one built anew, its top-k against full scoring, phrases against plain search."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from hanji import config
from hanji.operators import boolean, index
from hanji.operators import segments as sg
from hanji.sources.versions import Conflict, Versions

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "the", "the", "the", "of", "한글", "x9"]
split = lambda s: re.findall("[0-9A-Za-z가-힣_]{2,}", s.lower())


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def texts(seed, ids, longest=40):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, k=rng.randrange(longest)))) for i in ids]


def plain(df):
    return sorted((r["doc_id"], round(r["score"], 9)) for r in df.collect())


def same_as_rebuilt(spark, ix, model):
    """Rows are documents of their own in the index built anew, whatever their ids."""
    rows = [(i, t) for i, ts in model.items() for t in ts]
    built = index.build(made(spark, [(n, t) for n, (_, t) in enumerate(rows)])).persist()
    for terms in (["the", "beta", "nowhere"], ["한글", "x9", "of", "eps"]):
        want = sorted((rows[r["doc_id"]][0], round(r["score"], 9)) for r in index.search(built, terms).collect())
        assert plain(ix.search(terms)) == want
        got, seen = ix.top(terms, 5)
        assert [(r["doc_id"], round(r["score"], 9)) for r in got.collect()] == sorted(want, key=lambda r: (-r[1], r[0]))[:5]
        assert seen["scored"] <= seen["windows"]
    whole, stats = built.corpus_stats.first(), ix.statistics(["the"])
    assert (stats.n, round(stats.avgdl, 9)) == (whole["n"], round(whole["avgdl"], 9))


def test_changes_and_compaction_equal_an_index_built_anew(spark, tmp_path):
    model, ix = {}, sg.SegmentIndex(spark, f"file://{tmp_path}/ix")
    assert ix.version == 0 and ix.search(["alpha"]).count() == 0 and ix.compact() is ix
    loads = [texts(1, range(60)), texts(2, range(40, 90)), texts(3, [*range(200, 206), 0])]
    for rows in loads:
        ix = ix.add(made(spark, rows).repartition(3))
        model |= {i: [t] for i, t in rows}
    assert ix.search(["nowhere"]).count() == ix.search([]).count() == ix.top(["nowhere"], 3)[0].count() == 0
    ix = ix.delete(made(spark, [(i, None) for i in [*range(30, 50), 77, 999, None]]).select("doc_id"))
    model = {i: t for i, t in model.items() if not (30 <= i < 50 or i == 77)}
    same_as_rebuilt(spark, ix, model)
    # Deleting and adding in one version; null, empty and repeated rows.
    odd = [(1, "alpha alpha 한글"), (300, None), (301, ""), (302, "beta of"), (302, "gamma of")]
    ix = ix.apply(added=made(spark, odd), deleted=made(spark, [(2, ""), (55, "")]).select("doc_id"), note="kept")
    model = {i: t for i, t in model.items() if i not in (1, 2, 55)} | {1: ["alpha alpha 한글"], 300: [None], 301: [""], 302: ["beta of", "gamma of"]}
    same_as_rebuilt(spark, ix, model)
    before = ix
    ix = ix.compact()
    assert len(ix.segments) < len(before.segments) and ix.state["note"] == "kept"
    same_as_rebuilt(spark, ix, model)
    assert plain(before.search(["the"])) == plain(ix.search(["the"]))
    ix = ix.compact(every=True)
    assert len(ix.segments) == 1 and not ix.tombstones()
    assert ix.sweep() and not ix.sweep()
    same_as_rebuilt(spark, ix, model)
    ix = ix.delete(ix.documents().select("doc_id"))
    assert ix.segments == {} and ix.search(["the"]).count() == 0
    # An id that was null is never deleted.
    ix = ix.add(made(spark, [(None, "alpha"), (5, "alpha")])).delete(made(spark, [(None, ""), (5, "")]).select("doc_id"))
    assert [r["doc_id"] for r in ix.search(["alpha"]).collect()] == [None]


def test_a_writer_that_was_overtaken_fails_and_changes_nothing(spark, tmp_path):
    first = sg.SegmentIndex(spark, f"file://{tmp_path}/ix").add(made(spark, [(1, "alpha")]))
    slow = first.refreshed()
    first.add(made(spark, [(2, "alpha")]))
    with pytest.raises(Conflict):
        slow.add(made(spark, [(3, "alpha")]))
    now = slow.refreshed()
    assert sorted(r["doc_id"] for r in now.search(["alpha"]).collect()) == [1, 2]
    versions = Versions(spark, f"file://{tmp_path}/v")
    assert versions.newest() == (0, {}) and versions.commit(0, {"a": "한"}) == 1
    with pytest.raises(Conflict):
        versions.commit(0, {"a": 2})
    assert versions.newest() == (1, {"a": "한"}) and versions.commit(1, {}) == 2


def test_top_skips_windows_that_cannot_reach_the_threshold(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=8 + i % 400)) + (" rare" * 3 if i % 250 == 0 else "")) for i in range(2000)]
    ix = sg.SegmentIndex(spark, f"file://{tmp_path}/ix", window=(32, 2000)).add(made(spark, rows).repartition(2))
    full = sorted(((-r["score"], r["doc_id"]) for r in ix.search(["rare", "the"]).collect()))[:10]
    for pushed in (sg.PUSHED_WINDOWS, 0):
        monkeypatch.setattr(sg, "PUSHED_WINDOWS", pushed)
        got, seen = ix.top(["rare", "the"], 10)
        assert [r["doc_id"] for r in got.collect()] == [i for _, i in full]
        assert seen["windows"] > 50 and seen["scored"] < 0.5 * seen["windows"]
    bounds = {(r["segment"], r["window"]): r["bound"] for r in ix.windows(["the"], ix.statistics(["the"])).collect()}
    scores = ix._scored(ix.blocks().filter("term = 'the'"), ix.statistics(["the"])).collect()
    held = ix.blocks().filter("term = 'the'").select("segment", "window", F.explode("ords").alias("ord")).collect()
    window = {(r["segment"], r["ord"]): r["window"] for r in held}
    assert all(r["score"] <= bounds[r["segment"], window[r["segment"], r["ord"]]] for r in scores)


def test_phrases_and_boolean_queries_equal_plain_search(spark, tmp_path):
    rows = [*texts(7, range(150), 14), (500, None), (501, "the the the of"), (502, "of. THE, of!"), (503, "a b c")]
    ix = sg.SegmentIndex(spark, f"file://{tmp_path}/ix").add(made(spark, rows[:80])).add(made(spark, rows[80:])).delete(made(spark, [(3, ""), (9, "")]).select("doc_id"))
    held = {i: f" {' '.join(split(t or ''))} " for i, t in rows if i not in (3, 9)}
    has = lambda i, x: f" {' '.join(split(x))} " in held[i] or not split(x)
    for p in ("the the", "the the the of", "alpha", "of the of", "gamma delta eps", "nowhere of"):
        assert sorted(r["doc_id"] for r in ix.phrase(split(p)).collect()) == sorted(i for i in held if has(i, p))
    for q in ('"the the" of NOT alpha', "alpha AND beta OR 한글 NOT x9", 'NOT "of the"', "NOT the", '"c" alpha', "", "beta OR c"):
        asked = boolean.parse(q)
        want = [i for i in held if all(has(i, p) for p in asked.phrases) and not any(has(i, e) for e in asked.excludes) and (not asked.clauses or any(all(has(i, w) for w in c) for c in asked.clauses))]
        assert sorted(r["doc_id"] for r in ix.matching(asked, split).collect()) == sorted(want), q


def test_tokens_are_not_shuffled_to_tombstones_nor_kept_with_them(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"erin than w{i % 7} the") for i in range(200)], "doc_id long, text string")
    ix = sg.SegmentIndex(spark, str(tmp_path / "ix")).add(docs).delete(docs.filter("doc_id % 3 = 0"))
    with config.during(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = ix.documents()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(r["doc_id"] for r in ix.documents().collect()) == [i for i in range(200) if i % 3]
    assert ix.statistics(["erin", "w0"]).df == {"erin": 133, "w0": len([i for i in range(200) if i % 3 and i % 7 == 0])}
    for kind in ("docs", "postings", "terms", "dead", "less"):
        files = glob.glob(f"{tmp_path}/ix/{kind}/**/*.parquet", recursive=True)
        codecs = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups}
        assert codecs == {"ZSTD"}, kind
    assert all("tokens" not in pq.ParquetFile(f).schema_arrow.names for f in glob.glob(f"{tmp_path}/ix/dead/*/*.parquet"))
