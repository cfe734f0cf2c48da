"""Retrieval quality and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def golden_match(expected: dict[str, Column], source: Column, snippet: Column) -> Column:
    """Whether a hit meets all stated expectations; null expectations are not stated."""
    checks = {
        "source": lambda e: source == e, "source_contains": lambda e: source.contains(e),
        "snippet_contains": lambda e: snippet.contains(e),
    }
    ok = F.lit(True)
    for name, value in expected.items():
        ok = ok & F.coalesce(checks[name](value), F.lit(True))
    return ok


def query_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, first_rank, rr, dcg, found) from (query_id, rank, relevant); ranks from 1."""
    hit = F.col("relevant") & (F.col("rank") <= k)
    per = ranked.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first_rank"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    return per.withColumns({"rr": F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), "found": F.col("first_rank").isNotNull().cast("int")})


def corpus_metrics(queries: DataFrame, per_query: DataFrame) -> DataFrame:
    """Recall, MRR, nDCG (one relevant result is ideal) and the share of queries without any result."""
    joined = queries.select("query_id").join(per_query, "query_id", "left")
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return joined.agg(
        F.count("*").alias("n_queries"), F.round(mean(F.col("found").cast("double")), 6).alias("recall"), F.round(mean("rr"), 6).alias("mrr"),
        F.round(mean("dcg"), 6).alias("ndcg"), F.round(F.avg(F.col("found").isNull().cast("double")), 6).alias("zero_rate"),
    )


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.round(F.percentile(value, F.lit(p)), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


def hit_rate(hits: Column, misses: Column) -> Column:
    total = hits + misses
    return F.when(total > 0, F.floor(hits * 10000.0 / total + 0.5) / 100).otherwise(0.0)


def block_rate(allowed: Column, blocked: Column) -> Column:
    return F.floor(blocked * 10000.0 / F.greatest(F.lit(1), allowed + blocked) + 0.5) / 100


def embedding_parity(pairs: DataFrame, gate: float = 0.99) -> DataFrame:
    """Average, least and greatest cosine of (a, b) vectors, and whether the average passes."""
    from hanji.operators.retrieve import dot, l2_normalized

    cos = dot(l2_normalized(F.col("a")), l2_normalized(F.col("b")))
    stats = pairs.select(cos.alias("c")).agg(F.round(F.avg("c"), 6).alias("avg_cos"), F.round(F.min("c"), 6).alias("min_cos"), F.round(F.max("c"), 6).alias("max_cos"))
    return stats.withColumn("passed", F.col("avg_cos") >= gate)
