"""Quality rules as a short-circuit cascade (operator 5), in built-in functions only.

Each rule is a Boolean column that is true where a document fails. On a bounded sample, drawn by hash from the whole
table, the cascade measures what each rule costs and which rows it rejects, orders the rules greedily by rows rejected
(among those the earlier rules leave) per second, and evaluates them in that order inside one CASE, so that a rejected
document pays for no later rule. The verdict does not depend on the order; only the time does.

A rule's cost is the time of a job that evaluates it on many copies of the sample, less that of the same job without a
rule: the least of several runs each, taken in turns, so that neither starting a job nor warming up is counted.

Defined cases: null text has no words and fails the base rule; very long texts are judged whole; null ids and repeated
rows are judged like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanji.llm.common import settle, text_or_empty, word_array

#: Bounds of the sample on which rules are timed, in documents and characters.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 4_000_000
#: Characters that a timed job reads, about, as copies of the sample, and how often each job runs.
TIMED_CHARS, RUNS = 4_000_000, 3
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is a Spark expression over :func:`base_columns`, ``sql`` the same in DuckDB."""

    name: str
    fails: str
    sql: str | None = None


#: Thresholds of the method's own rules; a document is kept unless one of them clearly holds.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(
        "capitals",
        r"10 * length(regexp_replace(text, '[^\\p{Lu}]+', '')) > 4 * word_chars",
        r"10 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > 4 * word_chars",
    ),
    Rule(
        "few_letters",
        r"10 * length(regexp_replace(text, '[^\\p{L}]+', '')) < 5 * word_chars",
        r"10 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < 5 * word_chars",
    ),
    Rule("exclamations", "10 * (length(text) - length(replace(text, '!', ''))) > 5 * n_words"),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, wherever the optimizer moves the whole expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside a window of eight words that occurs twice or more in the text.

    Windows are compared by a 64-bit hash of eight 64-bit word hashes. Only documents that have equal windows pay for
    sorting; a text's arrays stay in its row, so nothing is shuffled. Intermediate arrays are bound to names: inlined
    into the functions that run per element they would be computed once per element.
    """

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def placed(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(ordered, i)["h"], F.lit(False))
        twice = F.transform(ordered, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"]))
        return _let(F.sort_array(F.filter(twice, lambda p: p.isNotNull())), covered)

    def repeated(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(ordered, placed)).otherwise(F.lit(0).cast("long"))

    def windowed(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return _let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))), repeated)

    found = _let(F.transform(words, lambda w: F.xxhash64(w)), windowed)
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0).cast("long"))


def base_columns(docs: DataFrame, *, keep=()) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (and ``keep``).

    The counts are computed as one struct and unpacked behind a generator of one row, below which no later filter or
    projection is pushed: a condition on several of them would otherwise split the text again for each.
    """
    text = F.col("text")

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    once = F.transform(F.array(word_array("text")), lambda w: _let(lines, lambda x: counts(w, x)))
    return docs.select("doc_id", text_or_empty("text").alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep]).select("*", F.inline(once))


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def sample(docs: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Base columns of at most ``rows`` whole documents, of at most ``chars`` characters in all, spread by hash over the table."""
    n = max(1, docs.count())
    few = docs.select("doc_id", text_or_empty("text").alias("text"), F.xxhash64("doc_id", "text").alias("_h"))
    few = few.filter(F.pmod("_h", F.lit(1 << 30)) < F.lit(min(1 << 30, -(-(2 * rows << 30) // n)))).orderBy("_h").limit(rows)
    running = F.sum(F.length("text")).over(Window.orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return settle(base_columns(few.withColumn("_sum", running).filter(F.col("_sum") <= chars)), files=1)


def costs(few: DataFrame, rules, *, chars: int = TIMED_CHARS, runs: int = RUNS) -> dict[str, float]:
    """Seconds that each rule takes on copies of the rows of ``few``, beyond what reading and copying them takes."""
    size = few.agg(F.sum(F.length("text"))).first()[0] or 0
    times = max(1, -(-chars // max(1, size)))
    copies = few.coalesce(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(min(times, 100_000)))).alias("_copy"))
    jobs = {None: copies.agg(F.count_if(F.length("text") < 0))} | {r.name: copies.agg(F.count_if((F.length("text") < 0) | F.coalesce(F.expr(r.fails), F.lit(False)))) for r in rules}
    least: dict[str | None, float] = {}
    for _ in range(runs):
        for name, job in jobs.items():
            began = time.perf_counter()
            job.collect()
            least[name] = min(least.get(name, float("inf")), time.perf_counter() - began)
    return {r.name: max(least[r.name] - least[None], 1e-4) for r in rules}


def order_rules(docs: DataFrame, rules=RULES, *, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, each judged on the sampled rows that the rules before it leave."""
    few = sample(docs, rows=sample_rows)
    spent = costs(few, rules)
    flags = [F.coalesce(F.expr(r.fails), F.lit(False)).alias(r.name) for r in rules]
    patterns = few.select(*flags).groupBy(*[r.name for r in rules]).count().collect()
    chosen, left = [], list(rules)
    while left:
        gain = {r.name: sum(p["count"] for p in patterns if p[r.name] and not any(p[c.name] for c in chosen)) for r in left}
        best = max(left, key=lambda r: (gain[r.name] / spent[r.name], -spent[r.name], r.name))
        chosen.append(best)
        left.remove(best)
    return chosen


def judge(docs: DataFrame, rules=RULES, *, keep=(), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base columns, base_failed, rejected_by (null if kept) and kept. ``text`` is part of the result."""
    based = base_columns(docs, keep=keep)
    cascade = F.when(F.expr(BASE_FAILED), F.lit("base"))
    for rule in order_rules(docs, rules, sample_rows=sample_rows):
        cascade = cascade.when(F.coalesce(F.expr(rule.fails), F.lit(False)), F.lit(rule.name))
    judged = based.withColumns({"base_failed": F.expr(BASE_FAILED), "rejected_by": cascade}).withColumn("kept", F.col("rejected_by").isNull())
    return judged.withColumnsRenamed({f"_keep_{c}": c for c in keep if c not in ("doc_id", "text")})


def op5_quality_cascade(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8)
), marked AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows
), covered AS (
  SELECT rid, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following FROM marked WHERE n > 1) GROUP BY rid
), based AS (
  SELECT d.doc_id, d.text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN covered c USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
       NOT (({BASE_FAILED}) OR {" OR ".join(f"({r.sql or r.fails})" for r in RULES)}) AS kept
FROM based
"""
