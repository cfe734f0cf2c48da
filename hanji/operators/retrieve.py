"""Retrieval: exact nearest neighbours, score normalization, fusion, rank fusion, reranking, context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanji import config
from hanji.functions.text import strip, truncated


def clamp_k(k: int) -> int:
    return max(config.MIN_K, min(int(k), config.MAX_K))


def valid_query(query: str) -> str:
    """The stripped query; ValueError where its length is out of bounds."""
    query = (query or "").strip()
    if not config.MIN_QUERY <= len(query) <= config.MAX_QUERY:
        raise ValueError(f"a query has {config.MIN_QUERY} to {config.MAX_QUERY} characters")
    return query


def squared_l2(vector: Column, query: list[float]) -> Column:
    """Squared distance in double precision; the query travels as a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(F.col(vector) if isinstance(vector, str) else vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    norm = F.greatest(l2_norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(doc_id, distance) of the k nearest; a map over the vectors and a bounded heap a partition, no shuffle of rows."""
    return vectors.select("doc_id", squared_l2("embedding", query).alias("distance")).orderBy("distance", "doc_id").limit(k)


def vector_scores(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distances to scores in [0.1, 1] over the fetched candidates (of each query in ``by``)."""
    w = Window.partitionBy(*(by or []))
    low, high = F.min("distance").over(w), F.max("distance").over(w)
    rng = F.when(high > low, high - low).otherwise(1.0)
    return hits.withColumn("vec_score", F.greatest(F.lit(0.1), 1 - (F.col("distance") - low) / (rng + 0.001)))


def bm25_scores(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    return hits.withColumn("bm25_score", F.col("score") / (F.max("score").over(Window.partitionBy(*(by or []))) + 0.001))


def fuse(vec: DataFrame, bm25: DataFrame, *, vector_weight=config.VECTOR_WEIGHT, bm25_weight=config.BM25_WEIGHT) -> DataFrame:
    """Full outer fusion on doc_id of two bounded candidate lists; a missing side scores 0."""
    both = vec.select("doc_id", "vec_score").join(bm25.select("doc_id", "bm25_score"), "doc_id", "full")
    both = both.select("doc_id", F.coalesce("vec_score", F.lit(0.0)).alias("vec_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"))
    return both.withColumn("score", vector_weight * F.col("vec_score") + bm25_weight * F.col("bm25_score"))


def hybrid(vec_hits: DataFrame, bm25_hits: DataFrame, chunks: DataFrame, k: int, *, sort_by="relevance", file_id=None, source=None) -> DataFrame:
    """Fused candidates with their chunks, filtered after fetching (as the fetch limits demand), sorted, limited to k.

    Candidates are at most 4k rows, so they are broadcast to the chunk table, which is read once and not shuffled.
    """
    fused = fuse(vector_scores(vec_hits), bm25_scores(bm25_hits))
    rows = chunks.join(F.broadcast(fused), "doc_id")
    if file_id:
        rows = rows.filter(F.col("file_id") == file_id)
    if source:
        rows = rows.filter(F.col("source") == source)
    return sort_hits(rows, sort_by).limit(clamp_k(k))


def sort_hits(rows: DataFrame, sort_by: str = "relevance") -> DataFrame:
    if sort_by == "filename":
        return rows.orderBy(F.col("source").asc(), F.col("score").desc(), F.col("doc_id").asc())
    if sort_by == "length":
        return rows.orderBy(F.length("text").desc(), F.col("score").desc(), F.col("doc_id").asc())
    return rows.orderBy(F.col("score").desc(), F.col("doc_id").asc())


def rank_fusion(hits: DataFrame, *, top_k: int | None = config.TOP_K, by: str | None = None) -> DataFrame:
    """Reciprocal ranks summed over variants. ``hits``: (by,) variant, doc_id, score; variant 0 weighs most."""
    keys = [by] if by else []
    rank = F.row_number().over(Window.partitionBy(*keys, "variant").orderBy(F.col("score").desc(), F.col("doc_id").asc()))
    weight = F.when(F.col("variant") == 0, config.RRF_FIRST).otherwise(config.RRF_REST)
    fused = hits.withColumn("_r", rank).groupBy(*keys, "doc_id").agg(F.sum(weight / (config.RRF_K + F.col("_r"))).alias("rrf"))
    if top_k is None:
        return fused
    if by:
        best = F.row_number().over(Window.partitionBy(by).orderBy(F.col("rrf").desc(), F.col("doc_id").asc()))
        return fused.withColumn("_n", best).filter(F.col("_n") <= top_k).drop("_n")
    return fused.orderBy(F.col("rrf").desc(), F.col("doc_id").asc()).limit(top_k)


def rerank(hits: DataFrame, query: str, *, top_k: int = config.RERANK_TOP_K) -> DataFrame:
    """Best by score, words of the query in the text, and being an article; the score itself stays."""
    words = sorted({w.lower() for w in query.split() if len(w) >= 2})
    text = F.lower(F.concat_ws(" ", F.coalesce("article_no", F.lit("")), F.coalesce("article_title", F.lit("")), "text"))
    overlap = sum((text.contains(w).cast("int") for w in words), F.lit(0))
    key = F.col("score") + overlap * config.OVERLAP_BONUS + F.when(F.col("chunk_type") == "article", config.ARTICLE_BONUS).otherwise(0.0)
    return hits.withColumn("rank_key", key).orderBy(F.col("rank_key").desc(), F.col("doc_id").asc()).limit(top_k)


def article_fast_path(chunks: DataFrame, article_no: str, *, top_k: int = config.TOP_K, file_id: str | None = None) -> DataFrame:
    """Chunks of exactly that article, in order, all with score 1."""
    rows = chunks.filter(F.regexp_replace("article_no", r"(?U)\s+", "") == article_no)
    if file_id:
        rows = rows.filter(F.col("file_id") == file_id)
    return rows.withColumn("score", F.lit(1.0)).orderBy("doc_id").limit(top_k)


def context_block(rank: Column, source: Column, article_no: Column, article_title: Column, text: Column) -> Column:
    title = F.when(F.coalesce(article_title, F.lit("")) != "", F.concat(F.lit("("), article_title, F.lit(")"))).otherwise("")
    article = F.when(F.coalesce(article_no, F.lit("")) != "", F.concat(F.lit(" "), article_no, title)).otherwise("")
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] 「"), source, F.lit("」"), article, F.lit("\n"), strip(text), F.lit("\n"))


def pack_context(ranked: DataFrame, *, by: list[str], limit: int = config.CONTEXT_CHARS) -> DataFrame:
    """Blocks in rank order while their lengths fit; the first always stays. ``ranked``: by, rank, block."""
    running = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("total", F.sum(F.length("block")).over(running)).filter((F.col("total") <= limit) | (F.col("rank") == 1))


def citations(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("excerpt", truncated("text", config.CITATION_EXCERPT))
