"""Registered queries on the index, retrieval, fusion, grounding and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hanji.functions import text as T
from hanji.operators import boolean, evaluate, grounding, index, retrieve, substrings
from hanji.plans.catalogue import query, table

TERMS = ["thtion", "erin", "licensed", "than"]
SECOND = ["thand", "erin", "onand"]
_IN = lambda terms: ", ".join(f"'{t}'" for t in terms)
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z가-힣_]{2,}')"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def _bm25_sql(terms, name="bm25"):
    return f"""
{name}_toks AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
{name}_corpus AS (SELECT count(*) AS n, sum(len(toks)) / count(*)::DOUBLE AS avgdl FROM {name}_toks),
{name}_tf AS (SELECT doc_id, len(toks) AS dl, term, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM {name}_toks) WHERE term IN ({_IN(terms)}) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (term), {name}_corpus GROUP BY doc_id)"""


def _scores(spark, sf, terms):
    return index.scan(_docs(spark, sf), terms).withColumn("score", F.round("score", 6))


L2_SQL = """
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
vec AS (SELECT vec_id AS doc_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance FROM embeddings, q)"""


def _query_vector(spark, sf):
    """One row; the query vector becomes a literal of the plan."""
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"])


def _distances(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows.select("doc_id", F.round(retrieve.squared_l2("embedding", _query_vector(spark, sf)), 6).alias("distance"))


@query("sf01_tokenize", f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(list_distinct({TOKENS}))::BIGINT AS n_distinct FROM documents")
def sf01_tokenize(spark, sf):
    tokens = T.tokenize("text")
    return _docs(spark, sf).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


@query("agg01_term_freq", f"SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL")
def agg01_term_freq(spark, sf):
    return index.term_frequencies(_docs(spark, sf))


@query(
    "agg02_doc_freq",
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS toks FROM documents)
SELECT term, count(*)::BIGINT AS df, round(ln(((SELECT count(*) FROM t) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf
FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM t) GROUP BY term""",
)
def agg02_doc_freq(spark, sf):
    built = index.build(_docs(spark, sf))
    return built.term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query("agg03_corpus_stats", f"SELECT count(*)::BIGINT AS n, round(sum(len({TOKENS})) / count(*)::DOUBLE, 6) AS avgdl FROM documents")
def agg03_corpus_stats(spark, sf):
    return index.corpus_statistics(index.document_lengths(_docs(spark, sf))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("agg05_bm25", f"WITH {_bm25_sql(TERMS)} SELECT doc_id, score FROM bm25")
def agg05_bm25(spark, sf):
    return _scores(spark, sf, TERMS)


@query("jn02_bm25_index", f"WITH {_bm25_sql(TERMS)} SELECT doc_id, score FROM bm25")
def jn02_bm25_index(spark, sf):
    return index.search(index.build(_docs(spark, sf)), TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "top01_bm25_topk",
    f"WITH {_bm25_sql(TERMS)} SELECT b.doc_id, score, source, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '...' ELSE text END AS content, length(text) > 1500 AS is_truncated "
    "FROM (SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 10) b JOIN documents USING (doc_id)",
)
def top01_bm25_topk(spark, sf):
    best = index.top(_scores(spark, sf, TERMS), 10)
    hits = _docs(spark, sf).join(F.broadcast(best), "doc_id")
    return hits.select("doc_id", "score", "source", T.truncated("text", 1500).alias("content"), (F.length("text") > 1500).alias("is_truncated"))


@query("jn10_knn_l2", f"WITH {L2_SQL} SELECT doc_id, distance FROM vec")
def jn10_knn_l2(spark, sf):
    return _distances(spark, sf)


@query("jn10_knn_topk", f"WITH {L2_SQL} SELECT doc_id, distance FROM vec ORDER BY distance, doc_id LIMIT 20")
def jn10_knn_topk(spark, sf):
    return _distances(spark, sf).orderBy("distance", "doc_id").limit(20)


@query(
    "sf50_l2_normalize",
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
n AS (SELECT vec_id, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) AS norm,
  (SELECT greatest(sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) FROM q) AS qn FROM embeddings)
SELECT vec_id AS doc_id, round(norm, 6) AS norm, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / norm / qn, 6) AS cosine FROM n, q""",
)
def sf50_l2_normalize(spark, sf):
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf)])
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.round(retrieve.l2_norm(e), 6).alias("norm"), F.round(retrieve.dot(retrieve.l2_normalized(e), retrieve.l2_normalized(q)), 6).alias("cosine")
    )


_TOP_VEC = f"{L2_SQL}, topv AS (SELECT * FROM vec ORDER BY distance, doc_id LIMIT 20), vs AS (SELECT doc_id, greatest(0.1, 1 - (distance - min(distance) OVER ()) / (CASE WHEN max(distance) OVER () > min(distance) OVER () THEN max(distance) OVER () - min(distance) OVER () ELSE 1.0 END + 0.001)) AS vec_score FROM topv)"
_TOP_BM = f"{_bm25_sql(TERMS)}, topb AS (SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 20), bs AS (SELECT doc_id, score / (max(score) OVER () + 0.001) AS bm25_score FROM topb)"


@query("agg06_vec_minmax", f"WITH {_TOP_VEC} SELECT doc_id, round(vec_score, 6) AS vec_score FROM vs")
def agg06_vec_minmax(spark, sf):
    return retrieve.vector_scores(_distances(spark, sf).orderBy("distance", "doc_id").limit(20)).select("doc_id", F.round("vec_score", 6).alias("vec_score"))


@query("agg07_bm25_norm", f"WITH {_TOP_BM} SELECT doc_id, round(bm25_score, 6) AS bm25_score FROM bs")
def agg07_bm25_norm(spark, sf):
    return retrieve.bm25_scores(index.top(_scores(spark, sf, TERMS), 20)).select("doc_id", F.round("bm25_score", 6).alias("bm25_score"))


def _chunks(spark, sf):
    return _docs(spark, sf).withColumns({"file_id": T.file_id("source"), "article_no": F.lit(None).cast("string"), "article_title": F.lit(None).cast("string"), "chunk_type": F.when(F.col("lang") == "fr", "article").otherwise("generic")})


_FUSED = f"WITH {_TOP_VEC}, {_TOP_BM}, fused AS (SELECT doc_id, coalesce(vec_score, 0) AS v, coalesce(bm25_score, 0) AS b, round(0.7 * coalesce(vec_score, 0) + 0.3 * coalesce(bm25_score, 0), 6) AS score FROM vs FULL JOIN bs USING (doc_id)), hits AS (SELECT doc_id, source, text, round(v, 6) AS vec_score, round(b, 6) AS bm25_score, score FROM fused JOIN documents USING (doc_id))"
_COLS = "doc_id, source, vec_score, bm25_score, score"


def _hybrid(spark, sf, order):
    vec = _distances(spark, sf).orderBy("distance", "doc_id").limit(20)
    bm = index.top(_scores(spark, sf, TERMS), 20)
    fused = retrieve.fuse(retrieve.vector_scores(vec), retrieve.bm25_scores(bm)).withColumn("score", F.round("score", 6))
    rows = _chunks(spark, sf).join(F.broadcast(fused), "doc_id")
    return retrieve.sort_hits(rows, order).limit(10).select("doc_id", "source", F.round("vec_score", 6).alias("vec_score"), F.round("bm25_score", 6).alias("bm25_score"), "score")


for _name, _order in (("relevance", "score DESC, doc_id"), ("filename", "source, score DESC, doc_id"), ("length", "length(text) DESC, score DESC, doc_id")):
    query(f"jn01_hybrid_{_name}", f"{_FUSED} SELECT {_COLS} FROM hits ORDER BY {_order} LIMIT 10")(lambda spark, sf, o=_name: _hybrid(spark, sf, o))


@query("flt01_postfilter", f"WITH {_bm25_sql(TERMS)}, top AS (SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 20) SELECT doc_id, score FROM top JOIN documents USING (doc_id) WHERE substr(sha1(source), 1, 24) = substr(sha1('src3'), 1, 24) OR source = 'src4'")
def flt01_postfilter(spark, sf):
    hits = _chunks(spark, sf).join(F.broadcast(index.top(_scores(spark, sf, TERMS), 20)), "doc_id")
    return hits.filter((F.col("file_id") == T.file_id(F.lit("src3"))) | (F.col("source") == "src4")).select("doc_id", "score")


@query("flt02_prefilter", f"WITH {_bm25_sql(TERMS)} SELECT doc_id, score FROM bm25 JOIN documents USING (doc_id) WHERE source = 'src3' ORDER BY score DESC, doc_id LIMIT 10")
def flt02_prefilter(spark, sf):
    wanted = _docs(spark, sf).filter(F.col("source") == "src3").select("doc_id")
    return index.top(_scores(spark, sf, TERMS).join(wanted, "doc_id", "left_semi"), 10)


@query("flt03_query_guard", "SELECT event_id, trim(event_type) AS query, length(trim(event_type)) BETWEEN 2 AND 500 AS valid, greatest(1, least(event_id % 20, 10))::BIGINT AS k FROM events")
def flt03_query_guard(spark, sf):
    q = F.trim("event_type")
    return table(spark, sf, "events").select("event_id", q.alias("query"), F.length(q).between(2, 500).alias("valid"), F.greatest(F.lit(1), F.least(F.col("event_id") % 20, F.lit(10))).cast("long").alias("k"))


_VARIANTS = f"WITH {_bm25_sql(TERMS, 'v0')}, {_bm25_sql(SECOND, 'v1')}, hits AS (SELECT 0 AS variant, * FROM (SELECT * FROM v0 ORDER BY score DESC, doc_id LIMIT 50) UNION ALL SELECT 1, * FROM (SELECT * FROM v1 ORDER BY score DESC, doc_id LIMIT 50)), ranked AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, doc_id) AS r FROM hits), rrf AS (SELECT doc_id, round(sum(CASE WHEN variant = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END / (60 + r)), 6) AS rrf FROM ranked GROUP BY doc_id)"


def _fused(spark, sf, k):
    first = index.top(_scores(spark, sf, TERMS), 50).withColumn("variant", F.lit(0))
    second = index.top(_scores(spark, sf, SECOND), 50).withColumn("variant", F.lit(1))
    return retrieve.rank_fusion(first.unionByName(second), top_k=None).withColumn("rrf", F.round("rrf", 6)).orderBy(F.col("rrf").desc(), "doc_id").limit(k)


@query("agg09_rrf", f"{_VARIANTS} SELECT doc_id, rrf FROM rrf ORDER BY rrf DESC, doc_id LIMIT 100")
def agg09_rrf(spark, sf):
    return _fused(spark, sf, 100)


@query("top03_rrf_topk", f"{_VARIANTS} SELECT doc_id, rrf FROM rrf ORDER BY rrf DESC, doc_id LIMIT 8")
def top03_rrf_topk(spark, sf):
    return _fused(spark, sf, 8)


@query("win01_variant_rank", f"{_VARIANTS} SELECT variant::INT AS variant, doc_id, r - 1 AS rank0 FROM ranked")
def win01_variant_rank(spark, sf):
    first = index.top(_scores(spark, sf, TERMS), 50).withColumn("variant", F.lit(0))
    second = index.top(_scores(spark, sf, SECOND), 50).withColumn("variant", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("variant").orderBy(F.col("score").desc(), "doc_id"))
    return first.unionByName(second).select("variant", "doc_id", (rank - 1).cast("long").alias("rank0"))


@query(
    "top04_rerank",
    f"""{_VARIANTS}, best AS (SELECT * FROM rrf ORDER BY rrf DESC, doc_id LIMIT 8)
SELECT doc_id, rrf AS score, round(rrf + 0.05 * ((CASE WHEN contains(lower('  ' || text), 'erin') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower('  ' || text), 'licensed') THEN 1 ELSE 0 END)) + (CASE WHEN lang = 'fr' THEN 0.2 ELSE 0.0 END), 6) AS rank_key
FROM best JOIN documents USING (doc_id) ORDER BY rank_key DESC, doc_id LIMIT 4""",
)
def top04_rerank(spark, sf):
    best = _fused(spark, sf, 8).withColumnRenamed("rrf", "score")
    hits = _chunks(spark, sf).join(F.broadcast(best), "doc_id")
    return retrieve.rerank(hits, "Erin licensed x").select("doc_id", "score", F.round("rank_key", 6).alias("rank_key"))


@query(
    "win02_context_pack",
    """WITH b AS (SELECT conv_id, turn + 1 AS rank, '[' || (turn + 1) || '] 「' || role || '」' || chr(10) || trim(text, ' ' || chr(10)) || chr(10) AS block FROM conversations),
r AS (SELECT *, sum(length(block)) OVER (PARTITION BY conv_id ORDER BY rank) AS total FROM b)
SELECT conv_id, rank, length(block)::BIGINT AS n, total::BIGINT AS total FROM r WHERE total <= 3000 OR rank = 1""",
)
def win02_context_pack(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("rank", F.col("turn") + 1)
    none = F.lit(None).cast("string")
    blocks = rows.select("conv_id", "rank", retrieve.context_block(F.col("rank"), F.col("role"), none, none, F.col("text")).alias("block"))
    return retrieve.pack_context(blocks, by=["conv_id"], limit=3000).select("conv_id", "rank", F.length("block").cast("long").alias("n"), F.col("total").cast("long").alias("total"))


@query(
    "flt04_boolean",
    r"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text || ' ' || source, '\s+', ' ', 'g'))) AS x FROM documents)
SELECT doc_id FROM t WHERE contains(x, 'the and') AND NOT contains(x, 'idiot') AND ((contains(x, 'erin') AND contains(x, 'tion')) OR (contains(x, 'licensed')))""",
)
def flt04_boolean(spark, sf):
    return boolean.boolean_filter(_docs(spark, sf), '"The  and" erin AND tion OR licensed NOT idiot').select("doc_id")


@query("flt05_boolean_phrase_not", r"WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text || ' ' || source, '\s+', ' ', 'g'))) AS x FROM documents) SELECT doc_id FROM t WHERE NOT contains(x, 'apache license') AND contains(x, 'licen')")
def flt05_boolean_phrase_not(spark, sf):
    return boolean.boolean_filter(_docs(spark, sf), 'licen NOT "apache license"').select("doc_id")


@query("flt06_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text || ' ' || source, '(?i)licen[sc]ed? under the [a-z]+')")
def flt06_regex(spark, sf):
    return boolean.regex_filter(_docs(spark, sf), "/licen[sc]ed? under the [a-z]+/g").select("doc_id")


@query("flt06_regex_invalid", "SELECT doc_id FROM documents WHERE false")
def flt06_regex_invalid(spark, sf):
    return boolean.regex_filter(_docs(spark, sf), "/licen([sc/").select("doc_id")


@query(
    "sf33_claims",
    r"""WITH lines AS (SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents),
cut AS (SELECT doc_id, CASE WHEN starts_with(line, '- ') THEN 1 WHEN line = '' OR starts_with(line, '|') OR starts_with(line, '#') THEN 0
  ELSE len(list_filter(string_split(regexp_replace(regexp_replace(line, '([!?])\s+', '\1' || chr(1), 'g'), '[.。]\s*', chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 12)) END AS n FROM lines),
per AS (SELECT doc_id, sum(n) AS n FROM cut GROUP BY doc_id)
SELECT d.doc_id, (CASE WHEN n > 0 THEN n WHEN length(trim(coalesce(text, ''))) > 12 THEN 1 ELSE 0 END)::BIGINT AS n_claims FROM documents d LEFT JOIN per USING (doc_id)""",
)
def sf33_claims(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(grounding.claims(F.col("text"))).cast("long").alias("n_claims"))


@query("sf33_claims_all")
def sf33_claims_all(spark, sf):
    """All claims of all documents, bullets and whole answers included; a null claim where a document has none. DuckDB cannot split so."""
    found = F.posexplode_outer(grounding.claims(F.col("text")))
    return _docs(spark, sf).select("doc_id", found.alias("position", "claim"))


_SUPPORT = """WITH ev AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark UNION ALL SELECT lower(regexp_replace(text, '\\s+', '', 'g')) FROM benchmark)),
cl AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 1)) AS w FROM documents),
ov AS (SELECT d.doc_id, count(cl.w) AS n, count(ev.w) AS o FROM documents d LEFT JOIN cl USING (doc_id) LEFT JOIN ev ON ev.w = cl.w GROUP BY d.doc_id)
SELECT doc_id, CASE WHEN n = 0 THEN 'not_checkable' WHEN o >= greatest(1, least(3, n // 2)) THEN 'supported' WHEN o > 0 THEN 'partial' ELSE 'unsupported' END AS status,
  round((CASE WHEN n = 0 THEN 1.0 WHEN o >= greatest(1, least(3, n // 2)) THEN least(1.0, greatest(0.35, o / n::DOUBLE)) WHEN o > 0 THEN greatest(0.1, o / n::DOUBLE) ELSE 0.0 END)::DOUBLE, 6) AS score FROM ov"""


@query("sf34_support", _SUPPORT)
def sf34_support(spark, sf):
    """Whole texts as claims: words meet the evidence's words in a join, so neither side has to fit a row."""
    evidence = table(spark, sf, "benchmark").select(F.explode(grounding.evidence_tokens(F.array("text"))).alias("w")).distinct()
    judged = grounding.support_by_join(_docs(spark, sf).select("doc_id", F.col("text").alias("claim")), evidence, "doc_id")
    return judged.select("doc_id", "s.status", F.round("s.score", 6).alias("score"))


@query(
    "jn14_citation_join",
    r"""WITH c AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '([0-9]+)', 1), lambda x: TRY_CAST(x AS BIGINT)))) AS n FROM documents)
SELECT c.doc_id, b.item_id FROM c JOIN benchmark b ON b.item_id = c.n""",
)
def jn14_citation_join(spark, sf):
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("long")))
    cited = _docs(spark, sf).select("doc_id", F.explode(numbers).alias("item_id"))
    return cited.join(table(spark, sf, "benchmark").select("item_id"), "item_id").select("doc_id", "item_id")


_RANKED = """gold AS (SELECT item_id AS query_id, string_split(text, ' ')[1:2] AS w FROM benchmark),
hits AS (SELECT query_id, doc_id, quality, n_chars, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank
  FROM gold JOIN documents ON contains(text, w[1] || ' ' || w[2]) JOIN labels USING (doc_id))"""


def _ranked(spark, sf):
    words = F.split("text", " ")
    gold = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.get(words, F.lit(0)), F.lit(" "), F.get(words, F.lit(1))).alias("w"))
    docs = table(spark, sf, "documents")
    pairs = substrings.contains_join(docs.select("doc_id", "text"), gold, name="query_id", pattern="w")
    hits = pairs.join(docs.select("doc_id", "n_chars"), "doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n_chars").desc(), "doc_id"))
    # What ranks below the tenth counts nowhere, and a query's first hit stays: each partition keeps its ten of a query.
    return gold.select("query_id"), hits.select("query_id", "doc_id", "quality", rank.alias("rank")).filter("rank <= 10")


@query(
    "agg22_ir_metrics",
    f"""WITH {_RANKED}, per AS (SELECT query_id, min(CASE WHEN quality = 1 AND rank <= 10 THEN rank END) AS fr, sum(CASE WHEN quality = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0.0 END) AS dcg FROM hits GROUP BY query_id)
SELECT count(*)::BIGINT AS n_queries, round(avg(CASE WHEN fr IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, round(avg(coalesce(1 / fr::DOUBLE, 0.0)), 6) AS mrr, round(avg(coalesce(dcg, 0.0)::DOUBLE), 6) AS ndcg,
round(avg(CASE WHEN per.query_id IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS zero_rate FROM gold LEFT JOIN per USING (query_id)""",
)
def agg22_ir_metrics(spark, sf):
    gold, ranked = _ranked(spark, sf)
    return evaluate.corpus_metrics(gold, evaluate.query_metrics(ranked.withColumn("relevant", F.col("quality") == 1), 10))


@query("jn13_golden_rank", f"WITH {_RANKED} SELECT query_id, min(CASE WHEN quality = 1 AND rank <= 10 THEN rank END)::BIGINT AS first_rank FROM hits GROUP BY query_id")
def jn13_golden_rank(spark, sf):
    _, ranked = _ranked(spark, sf)
    return evaluate.query_metrics(ranked.withColumn("relevant", F.col("quality") == 1), 10).select("query_id", F.col("first_rank").cast("long").alias("first_rank"))


@query("flt18_golden_match", "SELECT doc_id, source = 'src1' OR (contains(source, 'src') AND contains(substr(text, 1, 300), 'tion')) AS matched FROM documents")
def flt18_golden_match(spark, sf):
    snippet = F.substring("text", 1, 300)
    exact = evaluate.golden_match({"source": F.lit("src1")}, F.col("source"), snippet)
    parts = evaluate.golden_match({"source_contains": F.lit("src"), "snippet_contains": F.lit("tion"), "source": F.lit(None).cast("string")}, F.col("source"), snippet)
    return _docs(spark, sf).select("doc_id", (exact | parts).alias("matched"))


@query("agg23_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def agg23_percentiles(spark, sf):
    return evaluate.latency(table(spark, sf, "events"), "value", ["event_type"])


@query(
    "agg25_parity",
    """WITH p AS (SELECT a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), n AS (SELECT a, b, sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) AS na, sqrt(list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE))) AS nb FROM p),
c AS (SELECT list_sum(list_transform(list_zip(a, b), lambda q: q[1]::DOUBLE * q[2]::DOUBLE)) / na / nb AS c FROM n) SELECT round(avg(c), 6) AS avg_cos, round(min(c), 6) AS min_cos, round(max(c), 6) AS max_cos, round(avg(c), 6) >= 0.99 AS passed FROM c""",
)
def agg25_parity(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pairs = v.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("i"), F.col("embedding").alias("b")), "i")
    return evaluate.embedding_parity(pairs)
