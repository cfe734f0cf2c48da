"""The stored index against the one that is built."""

import random

import pytest

from hanji.operators import index


@pytest.mark.parametrize("repeated", [False, True])
def test_stored_tables_are_those_built_and_postings_are_shuffled_once(spark, tmp_path, repeated):
    rng = random.Random(3)
    rows = [(i // 2 if repeated else i, " ".join(rng.choices(["erin", "Than", "한글", "a", "x_1", "of"], k=rng.randrange(9)))) for i in range(80)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    built = index.build(docs)
    built.save(str(tmp_path / "i"))
    kept = index.Index.load(spark, str(tmp_path / "i"))
    for name in ("postings", "doc_stats", "term_stats", "corpus_stats"):
        want = getattr(built, name)
        same = lambda t, columns=want.columns: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.select(columns).collect()), key=str)
        assert same(getattr(kept, name)) == same(want), name
    found = lambda ix: {r["doc_id"]: round(r["score"], 9) for r in index.search(ix, ["erin", "한글", "nothing"]).collect()}
    assert found(kept) == found(built)
    plan = index.bucketed(docs, kept.doc_stats, kept.corpus_stats)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort ") == 1
