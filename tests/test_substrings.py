"""The substring join against plain containment."""

import random

from hanji.operators import substrings
from hanji.plans import catalogue


def test_pairs_equal_plain_containment(spark):
    rng = random.Random(2)
    letters = "ab c한😀\n."
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(60)))) for i in range(120)] + [(500, None), (501, ""), (7, "abcabcab"), (7, "abcabcab"), (502, "x" * 50_000 + "needle in it")]
    patterns = [(i, "".join(rng.choices(letters, k=1 + i % 9))) for i in range(90)] + [(900, None), (901, ""), (902, "abcabc"), (902, "abcabc"), (903, "needle"), (904, "xxxxxxxxx"), (905, "nowhere to be")]
    got = substrings.contains_join(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(patterns, "pattern_id long, pattern string"))
    want = [(d, p) for d, t in texts for p, s in patterns if t is not None and s and s in t]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    none = spark.createDataFrame([(1, "")], "pattern_id long, pattern string")
    assert substrings.contains_join(spark.createDataFrame(texts, "doc_id long, text string"), none).count() == 0


def test_goldens_meet_documents_without_a_nested_loop(spark):
    for name in ("jn13_golden_rank", "agg22_ir_metrics"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "contains" in plan.lower() and "Join Cross" not in plan
        joins = [line for line in plan.splitlines() if "Join " in line and "#" not in line]
        assert not joins, joins


def test_no_text_is_shuffled_and_windows_hold_long_patterns(spark):
    rng = random.Random(5)
    letters = "ab한\n"
    texts = [(i, "".join(rng.choices(letters, k=400))) for i in range(60)]
    patterns = [(i, texts[i][1][i : i + 1 + 5 * i]) for i in range(60)] + [(70, "ab" * 40)]
    frames = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(patterns, "pattern_id long, pattern string")
    got = substrings.contains_join(*frames)
    assert sorted(tuple(r) for r in got.collect()) == sorted((d, p) for d, t in texts for p, s in patterns if s in t)
    assert "_t#" not in got._jdf.queryExecution().optimizedPlan().toString()
