"""Line differences against the textbook recurrence."""

import random
from functools import cache

from hanji.operators import line_diff


def fewest(a, b):
    @cache
    def same(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + same(i + 1, j + 1) if a[i] == b[j] else max(same(i + 1, j), same(i, j + 1))

    return same(0, 0)


def split(text):
    parts = (text or "").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def test_changes_equal_the_recurrence_and_rebuild_both_versions(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choices("abcd", k=rng.randrange(14))), "\n".join(rng.choices("abcde", k=rng.randrange(14)))) for k in range(60)]
    rows += [(100, None, "x"), (101, "", ""), (102, "a\n", "a"), (103, "<&>", "<&>\n"), (104, "same\n" * 50, "same\n" * 70), (105, None, None)]
    pairs = spark.createDataFrame(rows, "key long, old string, new string")
    got = {r["key"]: (r["added"], r["removed"], r["total"]) for r in line_diff.counts(pairs).collect()}
    for k, a, b in rows:
        a, b = split(a), split(b)
        n = fewest(tuple(a), tuple(b))
        assert got[k] == (len(b) - n, len(a) - n, len(a) + len(b) - 2 * n)
    shown = {}
    for r in sorted(line_diff.changes(pairs).collect(), key=lambda r: (r["key"], r["place"])):
        shown.setdefault(r["key"], []).append((r["sign"], r["line"]))
    for k, a, b in rows:
        assert [x for s, x in shown.get(k, []) if s != "+"] == split(a) and [x for s, x in shown.get(k, []) if s != "-"] == split(b)
    html = {r["key"]: r["html"] for r in line_diff.html_table(line_diff.changes(pairs)).collect()}
    assert html[103] == '<table><tr class="kept"><td> </td><td>&lt;&amp;&gt;</td></tr></table>'
    assert html[100] == '<table><tr class="added"><td>+</td><td>x</td></tr></table>'


def test_lines_meet_as_digests_and_pairs_share_batches(spark):
    pairs = spark.createDataFrame([(k, f"a{k}\nb\nc" + "\nx" * k, f"b\nc\na{k}\n" + "x\n" * k) for k in range(300)], "key long, old string, new string")
    made = line_diff.aligned(pairs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "sha2(" in plan and "FlatMapGroups" not in plan
    assert {r["key"]: r["count"] for r in made.groupBy("key").count().collect()} == {k: 2 + k for k in range(300)}
