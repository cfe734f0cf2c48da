"""Registered queries on the indexes that change: segments of postings and cells of vectors."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from hanji.operators import boolean, chunking, index, segments, sketches, vector_index
from hanji.plans import table_functions
from hanji.plans.catalogue import query, table
from hanji.plans.queries_regulations import _REGULATION, M, N, O, S, derived
from hanji.plans.queries_search import L2_SQL, TERMS, TOKENS, _bm25_sql, _query_vector
from hanji.sources.versions import own_folder, stored


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _split(text: str) -> list[str]:
    return re.findall("[0-9A-Za-z가-힣_]{2,}", text.lower())


def _changed(spark, sf) -> segments.SegmentIndex:
    """Documents in three loads; then some changed and others deleted in one version."""
    docs = _docs(spark, sf)
    ix = segments.SegmentIndex(spark, own_folder(spark, "segments"))
    for part in range(3):
        ix = ix.add(docs.filter(F.pmod("doc_id", F.lit(3)) == part))
    changed = docs.filter("doc_id % 11 = 5").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" licensed than erin")).alias("text"))
    return ix.apply(added=changed, deleted=docs.filter("doc_id % 7 = 3 AND doc_id % 11 <> 5").select("doc_id"))


_CHANGED = "documents AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN coalesce(text, '') || ' licensed than erin' ELSE text END AS text, source, lang FROM main.documents WHERE doc_id % 11 = 5 OR doc_id % 7 <> 3)"


@query("snk11_segments_changed", f"WITH {_CHANGED}, {_bm25_sql(TERMS)} SELECT doc_id, score FROM bm25")
def snk11_segments_changed(spark, sf):
    """Scores over segments with tombstones."""
    return _changed(spark, sf).search(TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query("win05_segments_compacted", f"WITH {_CHANGED}, {_bm25_sql(TERMS)} SELECT doc_id, score FROM bm25")
def win05_segments_compacted(spark, sf):
    """The same scores after all segments have become one, with new ordinals."""
    return _changed(spark, sf).compact(every=True).search(TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query("top01_block_max", f"WITH {_bm25_sql(TERMS)} SELECT doc_id, score FROM bm25 ORDER BY score DESC, doc_id LIMIT 10")
def top01_block_max(spark, sf):
    """The ten best, from the windows whose bounds reach the threshold."""
    best, _ = segments.SegmentIndex(spark, own_folder(spark, "segments")).add(_docs(spark, sf)).top(TERMS, 10)
    return best.select("doc_id", F.round("score", 6).alias("score"))


_RUN = f"SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS x FROM documents"


@query("flt05_phrase_index", f"SELECT doc_id FROM ({_RUN}) WHERE contains(x, ' than onand ') OR contains(x, ' licensed under the ')")
def flt05_phrase_index(spark, sf):
    ix = segments.SegmentIndex(spark, own_folder(spark, "segments")).add(_docs(spark, sf))
    return ix.matching(boolean.parse("than_onand OR licensed_under_the"), lambda word: word.split("_"))


@query("flt04_boolean_index", f"SELECT doc_id FROM ({_RUN}) WHERE contains(x, ' the and ') AND NOT contains(x, ' of the ') AND ((contains(x, ' erin ') AND contains(x, ' than ')) OR contains(x, ' licensed '))")
def flt04_boolean_index(spark, sf):
    ix = segments.SegmentIndex(spark, own_folder(spark, "segments")).add(_docs(spark, sf))
    return ix.matching(boolean.parse('"the and" erin AND than OR licensed NOT "of the"'), _split)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query("jn10_ivf_topk", f"WITH {L2_SQL} SELECT doc_id, distance FROM vec ORDER BY distance, doc_id LIMIT 20")
def jn10_ivf_topk(spark, sf):
    """The twenty nearest, exactly, from the cells that can hold them."""
    ix = vector_index.VectorIndex(spark, own_folder(spark, "vectors")).build(_vectors(spark, sf))
    best, _ = ix.nearest(_query_vector(spark, sf), 20)
    return best.select("doc_id", F.round("distance", 6).alias("distance"))


@query("jn10_ivf_recall", "SELECT count(*)::BIGINT AS n_queries, 10 AS k, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def jn10_ivf_recall(spark, sf):
    """Whether coded search finds at least 0.9 of the ten nearest, which a scan of all vectors for every query tells."""
    rows = _vectors(spark, sf)
    ix = vector_index.VectorIndex(spark, own_folder(spark, "vectors")).build(rows)
    asked = rows.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    near = vector_index.nearest_many(asked, rows, 10, size=ix.state["size"]).select("query_id", "doc_id")
    found = ix.search_many(asked, 10, nprobe=ix.probes_for(0.95)).select("query_id", "doc_id", F.lit(1).alias("hit"))
    recall = near.join(found, ["query_id", "doc_id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") / F.count("*")).alias("recall"))
    return recall.select("n_queries", F.lit(10).alias("k"), (F.col("recall") >= 0.9).alias("reached"))


_LOADED = L2_SQL.replace("FROM embeddings, q", "FROM embeddings, q WHERE vec_id % 5 <> 1")


@query("ml04_vector_loads", f"WITH {_LOADED} SELECT doc_id, distance FROM vec ORDER BY distance, doc_id LIMIT 20")
def ml04_vector_loads(spark, sf):
    """Vectors trained and loaded by a third, added in two more loads, some deleted, all rebuilt."""
    rows = _vectors(spark, sf)
    ix = vector_index.VectorIndex(spark, own_folder(spark, "vectors")).build(rows.filter("doc_id % 3 = 0"))
    for part in (1, 2):
        ix = ix.add(rows.filter(F.col("doc_id") % 3 == part))
    ix = ix.delete(rows.filter("doc_id % 5 = 1").select("doc_id")).rebuild()
    best, _ = ix.nearest(_query_vector(spark, sf), 20)
    return best.select("doc_id", F.round("distance", 6).alias("distance"))


# Table functions


@query("ml09_search_function", f"WITH {_bm25_sql(TERMS)} SELECT doc_id, score FROM bm25 ORDER BY score DESC, doc_id LIMIT 10")
def ml09_search_function(spark, sf):
    """``search`` called from SQL text."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS article_no", "lang AS article_title")
    table_functions.register_search(spark, index.build(docs), docs)
    return spark.sql(f"SELECT doc_id, round(score, 6) AS score FROM search('{' '.join(TERMS)}')")


@query("ml09_article_function", "SELECT doc_id, (CASE WHEN contains(lower(coalesce(lang, '')), 'en') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'en') THEN 1 ELSE 0 END)::INT AS score FROM documents WHERE contains(lower(coalesce(lang, '') || ' ' || coalesce(text, '')), 'en') ORDER BY score DESC, doc_id LIMIT 50")
def ml09_article_function(spark, sf):
    """``get_article`` called from SQL text."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS article_no", "lang AS article_title")
    table_functions.register_search(spark, index.build(docs.limit(0)), docs)
    return spark.sql("SELECT * FROM get_article('EN')")


@query("sf18_chunk_function", "SELECT count(*)::BIGINT AS n_documents, true AS same FROM documents")
def sf18_chunk_function(spark, sf):
    """``chunk_document`` from SQL text against the DataFrame form, over all documents."""
    table_functions.register(spark)
    docs = table(spark, sf, "documents")
    docs.createOrReplaceTempView("hanji_documents")
    called = spark.sql("SELECT d.doc_id, c.chunk_id, md5(c.chunk) AS h FROM hanji_documents d, LATERAL chunk_document(d.text, 500, 50) c")
    split = docs.select("doc_id", F.posexplode(chunking.split(F.col("text"), 500, 50)).alias("chunk_id", "chunk")).select("doc_id", "chunk_id", F.md5("chunk").alias("h"))
    differing = called.exceptAll(split).unionAll(split.exceptAll(called)).agg((F.count("*") == 0).alias("same"))
    return docs.agg(F.count("*").alias("n_documents")).crossJoin(F.broadcast(differing))


@query("sf16_article_function", f"""SELECT doc_id, 0 AS pos, '제' || {N} || '조' AS number, {S} || ') 첫째 줄' AS title, 0 AS n_paragraphs FROM documents
UNION ALL SELECT doc_id, 1, '제' || {M} || '조', '둘) ① 하나', 1 FROM documents UNION ALL SELECT doc_id, 2, '제' || {O} || '조의2', {S}, 0 FROM documents""")  # fmt: skip
def sf16_article_function(spark, sf):
    table_functions.register(spark)
    derived(spark, sf, text=_REGULATION).createOrReplaceTempView("hanji_regulations")
    return spark.sql("SELECT r.doc_id, a.pos, a.number, a.title, a.n_paragraphs FROM hanji_regulations r, LATERAL parse_articles(r.text) a")


@query("win04_number_function", "WITH p AS (SELECT doc_id // 20 AS file, doc_id, trim(coalesce(text, '')) <> '' AS kept FROM documents) SELECT file, doc_id, (sum(kept::INT) OVER (PARTITION BY file ORDER BY doc_id) - 1)::INT AS number, (count(*) OVER (PARTITION BY file))::INT AS total_chunks FROM p QUALIFY kept")
def win04_number_function(spark, sf):
    """``number_chunks`` by file: documents as the chunks of files of twenty."""
    table_functions.register(spark)
    table(spark, sf, "documents").selectExpr("floor(doc_id / 20) AS file", "doc_id", "text AS chunk").createOrReplaceTempView("hanji_file_chunks")
    return spark.sql("SELECT file, doc_id, number, total_chunks FROM number_chunks(TABLE(hanji_file_chunks) PARTITION BY file ORDER BY doc_id)")


# Sketches, by day, merged over the month


def _days(spark, sf):
    events = table(spark, sf, "events").withColumn("item", F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")))
    return stored(sketches.collected(events, at="ts", size="1 day", value="value", key="user_id", item="item", by=("event_type",)), "sketches")


@query("agg12_sketch_popular", "SELECT event_type || '-' || (user_id % 7) AS item, count(*)::BIGINT AS cnt FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00' GROUP BY item ORDER BY cnt DESC, item LIMIT 10")
def agg12_sketch_popular(spark, sf):
    """Two weeks' most frequent searches, from the days' tracked items."""
    weeks = _days(spark, sf).filter("start >= TIMESTAMP '2024-01-08 00:00:00' AND start < TIMESTAMP '2024-01-22 00:00:00'")
    found = sketches.popular(sketches.merged(weeks), 100)
    return found.select("item", F.col("count").alias("cnt")).orderBy(F.col("cnt").desc(), "item").limit(10)


@query("agg23_sketch_quantiles", "SELECT event_type, count(*)::BIGINT AS n, true AS p50_near, true AS p95_near, true AS p99_near, true AS users_near FROM events GROUP BY event_type")
def agg23_sketch_quantiles(spark, sf):
    """Whether the merged sketches' quantiles have the ranks that they should, to 2 %, and users' numbers to 6 %, by the exact ones."""
    month = sketches.merged(_days(spark, sf), by=("event_type",))
    told = month.select("event_type", "n", *[sketches.quantile("kll", p).alias(f"q{i}") for i, p in enumerate((0.5, 0.95, 0.99))], sketches.distinct("hll").alias("users"))
    events = table(spark, sf, "events").select("event_type", "value", "user_id").join(F.broadcast(told), "event_type")
    below = lambda i: F.count_if(F.col("value") < F.col(f"q{i}")) / F.first("n")
    upto = lambda i: F.count_if(F.col("value") <= F.col(f"q{i}")) / F.first("n")
    near = lambda i, p: ((below(i) <= p + 0.02) & (upto(i) >= p - 0.02)).alias(f"p{round(100 * p)}_near")
    users = (F.abs(F.first("users") - F.countDistinct("user_id")) <= 0.06 * F.countDistinct("user_id") + 1).alias("users_near")
    return events.groupBy("event_type").agg(F.first("n").alias("n"), near(0, 0.5), near(1, 0.95), near(2, 0.99), users)
