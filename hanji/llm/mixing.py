"""Mixing sources to target weights (operator 4), in built-in functions only.

Sizes are word counts. Targets are a water filling: sources share a budget by weight, no target exceeds ``cap`` times
its source's size, and what a capped source cannot take is shared again by weight. Only one row per source is ordered
globally; the documents are read once for the totals and once for the draw and, up to :data:`BROADCAST_SOURCES`
sources, are never shuffled.

A document is emitted ``floor(rate)`` times, and once more where a hash of the seed and its id, read as a number in
[0, 1), is below the rate's fraction: a Bernoulli copy that every rerun draws alike.

Defined cases: null text has size 0 and is taken 0 words; a null source is a source of its own, ordered last; rows that
repeat an id draw alike; sources of size 0 have target 0; an empty table gives an empty result; other columns are
ignored by :func:`plan` and carried along by :func:`emit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanji.llm.common import keep as cached
from hanji.llm.common import word_array

WEIGHTS = (5, 2, 1)
BUDGET, CAP, SEED = 1.5, 2, "mix-1"
#: Up to so many sources (one short row each, a few MB) are sent to every executor; beyond, the join shuffles.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, budget=BUDGET, cap=CAP) -> DataFrame:
    """(source, source_size, target) from one row per source. Sources with small cap/weight fill first.

    With sources in order of cap*size/weight, a source is capped if its cap is at most its share of what the capped
    ones before it leave: share = (budget*total - caps before) * weight / (weights from here on). That test fails from
    some source on, for that source and all after it, and from there on the share's quotient stays fixed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.select("source", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size")).withColumn("w", weight.cast("long"))
    fill = Window.orderBy((F.col("source_size") * cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    steps = weighed.withColumns({
        "left": budget * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    }).withColumn("capped", F.col("source_size") * cap * F.col("w_left") <= F.col("left") * F.col("w"))
    open_left = F.max(F.when(~F.col("capped"), F.col("left"))).over(every)
    open_w = F.max(F.when(~F.col("capped"), F.col("w_left"))).over(every)
    target = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(open_left * F.col("w") / open_w)
    return steps.select("source", "source_size", target.cast("double").alias("target"))


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from md5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def plan(docs: DataFrame, *, weights=WEIGHTS, budget=BUDGET, cap=CAP, seed=SEED, keep=()) -> DataFrame:
    """Each document's size, its source's size and target, the copies drawn and the words taken; ``keep`` columns as _keep_NAME."""
    sized = docs.select("doc_id", "source", F.size(word_array("text")).cast("long").alias("size"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, budget=budget, cap=cap)
    targets = cached(targets)
    renamed = targets.withColumnRenamed("source", "_source")
    if targets.count() <= BROADCAST_SOURCES:
        renamed = F.broadcast(renamed)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    joined = sized.join(renamed, sized["source"].eqNullSafe(renamed["_source"]), "left")
    return joined.withColumn("copies", F.floor(rate).cast("long") + extra).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[f"_keep_{c}" for c in keep]
    )


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: every document as often as the plan says, with the columns of ``docs``."""
    planned = plan(docs, keep=docs.columns, **options).filter("copies > 0")
    repeated = planned.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sized GROUP BY source
), steps AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (2 * coalesce(sum(source_size) OVER before, 0))::DOUBLE AS left_over,
         (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS w_left
  FROM per WINDOW before AS (ORDER BY source_size * 2 / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, (source_size * 2 * w_left)::DOUBLE <= left_over * w AS capped FROM steps
), targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (source_size * 2)::DOUBLE
              ELSE (max(left_over) FILTER (NOT capped) OVER ()) * w / (max(w_left) FILTER (NOT capped) OVER ()) END AS target
  FROM marked
), drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM drawn
"""
