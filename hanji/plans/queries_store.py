"""Registered queries on stores, lifecycle, limits and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hanji.functions.text import file_id
from hanji.operators import chunking, evaluate, limits, stores
from hanji.plans.catalogue import query, table
from hanji.sources.versions import own_folder
from hanji.streaming import jobs, keyed


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _tags(spark, sf):
    """Labels as tags of sources."""
    rows = _docs(spark, sf).select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    tag = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    return rows.select(F.col("source").alias("filename"), tag.alias("tag"))


_TAGS = "tags AS (SELECT source AS filename, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS tag FROM documents JOIN labels USING (doc_id))"


@query("agg11_tag_stats", f"WITH {_TAGS} SELECT tag, count(*)::BIGINT AS cnt FROM tags GROUP BY tag")
def agg11_tag_stats(spark, sf):
    return stores.tag_counts(_tags(spark, sf))


@query("agg14_distinct_tags", f"WITH {_TAGS} SELECT DISTINCT filename, tag FROM tags")
def agg14_distinct_tags(spark, sf):
    return _tags(spark, sf).distinct()


@query("jn08_files_tags", f"WITH {_TAGS}, f AS (SELECT DISTINCT source AS name, substr(sha1(source), 1, 24) AS file_id FROM documents) SELECT f.name, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags FROM f LEFT JOIN tags ON tags.filename = f.name OR tags.filename = f.file_id GROUP BY f.name")
def jn08_files_tags(spark, sf):
    files = _docs(spark, sf).select(F.col("source").alias("name")).distinct().withColumn("file_id", file_id("name"))
    return stores.files_with_tags(files, _tags(spark, sf)).select("name", F.array_join("tags", ",").alias("tags"))


@query("snk03_set_tags", f"WITH {_TAGS} SELECT filename, tag, count(*)::BIGINT AS n FROM (SELECT * FROM tags WHERE filename NOT IN ('src0', 'src1') UNION ALL VALUES ('src0', 'a'), ('src0', 'b')) GROUP BY ALL")
def snk03_set_tags(spark, sf):
    new = spark.createDataFrame([("src0", ["a", " a ", "", "b"]), ("src1", [" "])], "filename string, tags array<string>")
    return stores.set_tags(_tags(spark, sf), new).groupBy("filename", "tag").agg(F.count("*").alias("n"))


@query("snk03_remove_tag", f"WITH {_TAGS} SELECT DISTINCT filename, tag FROM tags WHERE NOT (filename = 'src2' AND tag = 'good') UNION SELECT 'src2', 'new'")
def snk03_remove_tag(spark, sf):
    gone = spark.createDataFrame([("src2", "good")], "filename string, tag string")
    new = spark.createDataFrame([("src2", "new")], "filename string, tag string")
    return stores.add_tags(stores.remove_tags(_tags(spark, sf), gone), new)


def _history(spark, sf):
    return table(spark, sf, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("query"), F.col("ts").cast("timestamp").alias("ts"))


_HISTORY = "h AS (SELECT event_type || '-' || (user_id % 7) AS query, ts FROM events)"


@query("agg12_popular", f"WITH {_HISTORY} SELECT query, count(*)::BIGINT AS cnt FROM h GROUP BY query ORDER BY cnt DESC, query LIMIT 10")
def agg12_popular(spark, sf):
    return stores.popular(_history(spark, sf), 10)


@query("agg13_recent", f"WITH {_HISTORY} SELECT query, max(ts) AS last_ts FROM h GROUP BY query ORDER BY last_ts DESC, query LIMIT 10")
def agg13_recent(spark, sf):
    return stores.recent(_history(spark, sf), 10)


@query("flt09_suggest", f"WITH {_HISTORY} SELECT query, max(ts) AS last_ts FROM h WHERE query LIKE 'c%' GROUP BY query ORDER BY last_ts DESC, query LIMIT 5")
def flt09_suggest(spark, sf):
    return stores.suggest(_history(spark, sf), "c", 5)


def _revisions(spark, sf):
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = _docs(spark, sf).select(F.col("source").alias("filename"), F.col("doc_id").alias("id"), "n_chars", number.alias("n"))
    return rows.withColumn("version", F.when(F.col("n") % 5 == 0, "draft").otherwise(F.concat(F.lit("v"), F.floor(F.col("n") / 2).cast("string"))))


_REV = "rev AS (SELECT source AS filename, doc_id AS id, n_chars, CASE WHEN row_number() OVER w % 5 = 0 THEN 'draft' ELSE 'v' || floor(row_number() OVER w / 2)::BIGINT END AS version FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))"


@query("agg17_next_version", f"WITH {_REV} SELECT filename, 'v' || (coalesce(max(TRY_CAST(regexp_extract(version, '^v([0-9]+)$', 1) AS INT)), 0) + 1) AS next_version FROM rev GROUP BY filename")
def agg17_next_version(spark, sf):
    return stores.next_versions(_revisions(spark, sf))


@query("win06_latest", f"WITH {_REV} SELECT filename, version, max(id) AS id FROM rev GROUP BY filename, version")
def win06_latest(spark, sf):
    return stores.latest_revisions(_revisions(spark, sf)).select("filename", "version", "id")


@query("jn12_version_pairs", f"WITH {_REV}, l AS (SELECT filename, version, max(id) AS id FROM rev GROUP BY ALL) SELECT a.filename, a.id AS id1, b.id AS id2 FROM l a JOIN l b ON a.filename = b.filename AND a.version = 'v1' AND b.version = 'v2'")
def jn12_version_pairs(spark, sf):
    latest = stores.latest_revisions(_revisions(spark, sf)).select("filename", "version", "id")
    one = latest.filter("version = 'v1'").select("filename", F.col("id").alias("id1"))
    return one.join(latest.filter("version = 'v2'").select("filename", F.col("id").alias("id2")), "filename")


@query("snk04_revision_name", "SELECT event_id, event_type || '_v1_' || strftime(ts, '%Y%m%d_%H%M%S') || '.txt' AS name FROM events")
def snk04_revision_name(spark, sf):
    return table(spark, sf, "events").select("event_id", stores.revision_name(F.col("event_type"), F.lit("v1"), F.col("ts")).alias("name"))


@query("win07_last6", "SELECT conv_id, turn, role, substr(text, 1, 2000) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 AND role IN ('user', 'assistant')")
def win07_last6(spark, sf):
    return stores.last_turns(table(spark, sf, "conversations"))


@query("jn09_conversation", "SELECT conv_id, substr(min_by(text, turn), 1, 40) AS title, md5(string_agg('## ' || role || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY turn)) AS markdown FROM conversations GROUP BY conv_id")
def jn09_conversation(spark, sf):
    return stores.conversation_documents(table(spark, sf, "conversations")).select("conv_id", "title", F.md5("markdown").alias("markdown"))


@query("snk05_delete_conversation", "SELECT conv_id, max(turn) AS updated_at, count(*)::BIGINT AS n FROM conversations WHERE conv_id % 10 <> 3 GROUP BY conv_id")
def snk05_delete_conversation(spark, sf):
    messages = table(spark, sf, "conversations")
    gone = messages.filter("conv_id % 10 = 3").select("conv_id").distinct()
    return messages.join(gone, "conv_id", "left_anti").groupBy("conv_id").agg(F.max("turn").alias("updated_at"), F.count("*").alias("n"))


@query("flt11_visible", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 = 0")
def flt11_visible(spark, sf):
    conversations = table(spark, sf, "conversations").select("conv_id").distinct()
    return stores.visible(conversations, conversations.filter("conv_id % 3 = 0"))


@query("str10_claims", "SELECT user_id AS session, event_id AS conv_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 5")
def str10_claims(spark, sf):
    claims = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("conv_id"), F.col("ts").alias("at"))
    return stores.claimed(claims, 5).select("session", "conv_id")


@query("snk09_bookmarks", "SELECT doc_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1 ORDER BY n_chars DESC, doc_id LIMIT 50")
def snk09_bookmarks(spark, sf):
    rows = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("ts"))
    return stores.bookmarks(rows).select("id")


@query("flt17_bookmark_filter", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAYS AND contains(lower(event_type), 'c')")
def flt17_bookmark_filter(spark, sf):
    recent = F.col("ts") > F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00' - INTERVAL 7 DAYS")
    return table(spark, sf, "events").filter(recent & F.lower("event_type").contains("c")).select("event_id")


_LISTS = "listing AS (SELECT doc_id AS key, n_chars + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS size, 0.0::DOUBLE AS mtime FROM documents WHERE doc_id % 7 <> 2), manifest AS (SELECT doc_id AS key, n_chars AS size, 0.0::DOUBLE AS mtime FROM documents WHERE doc_id % 5 <> 3)"


def _lists(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"), F.lit(0.0).alias("mtime"))
    return docs.filter("key % 7 <> 2").withColumn("size", F.col("size") + F.when(F.col("key") % 10 == 1, 1).otherwise(0)), docs.filter("key % 5 <> 3")


@query("jn06_manifest_diff", f"WITH {_LISTS} SELECT coalesce(l.key, m.key) AS key, CASE WHEN l.key IS NULL THEN 'removed' WHEN l.size = m.size AND l.mtime = m.mtime THEN 'cached' ELSE 'process' END AS action FROM listing l FULL JOIN manifest m ON l.key = m.key")
def jn06_manifest_diff(spark, sf):
    return stores.manifest_diff(*_lists(spark, sf))


@query("set06_manifest_merge", f"WITH {_LISTS} SELECT coalesce(l.key, m.key) AS key, coalesce(l.size, m.size) AS size, coalesce(l.mtime, m.mtime) AS mtime FROM listing l FULL JOIN manifest m ON l.key = m.key")
def set06_manifest_merge(spark, sf):
    new, old = _lists(spark, sf)
    return stores.merged_manifest(old, new)


@query("jn07_remove_file", "SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') AND NOT (lang = 'fr' AND source = 'src5')")
def jn07_remove_file(spark, sf):
    bare = (F.col("lang") == "fr") & (F.col("source") == "src5")
    chunks = _docs(spark, sf).select("doc_id", "source", F.when(bare, "").otherwise(F.concat(F.lit("/d/"), "source")).alias("path"), F.when(bare, "").otherwise(file_id("source")).alias("file_id"))
    gone = spark.createDataFrame([("/d/src1", "", "none"), ("", "x", "src5")], "path string, file_id string, source string").unionByName(
        spark.range(1).select(F.lit("").alias("path"), file_id(F.lit("src2")).alias("file_id"), F.lit("none").alias("source"))
    )
    return stores.without_files(chunks, gone).select("doc_id")


@query("win05_renumber", "SELECT doc_id AS old_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM documents WHERE source <> 'src1'")
def win05_renumber(spark, sf):
    return chunking.numbered(_docs(spark, sf).filter("source <> 'src1'").select(F.col("doc_id").alias("old_id")), ["old_id"], "new_id", 8).select("old_id", F.col("new_id").cast("long").alias("new_id"))


@query("flt16_by_name", "SELECT substr(sha1('src3'), 1, 24) AS file_id, 'src3' AS name")
def flt16_by_name(spark, sf):
    files = _docs(spark, sf).select(F.col("source").alias("name")).distinct().withColumn("file_id", file_id("name"))
    found = stores.files_by_name(files, "src3")
    return spark.createDataFrame([(found["file_id"], found["name"])], "file_id string, name string")


@query("flt14_keys", "SELECT DISTINCT doc_id FROM documents WHERE source IN ('src1', 'src9') OR substr(sha1(source), 1, 24) IN ('src1', 'src9')")
def flt14_keys(spark, sf):
    return _docs(spark, sf).filter(F.col("source").isin("src1", "src9") | file_id("source").isin("src1", "src9")).select("doc_id").distinct()


@query("agg28_first_of_file", "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source ORDER BY 1 LIMIT 200")
def agg28_first_of_file(spark, sf):
    return stores.first_of_file(_docs(spark, sf).withColumn("file_id", file_id("source"))).select("doc_id", "source")


@query("agg15_corpus_stats", "SELECT count(DISTINCT source)::BIGINT AS files, count(*)::BIGINT AS chunks, sum(n_chars)::BIGINT AS size FROM documents")
def agg15_corpus_stats(spark, sf):
    return _docs(spark, sf).agg(F.countDistinct("source").alias("files"), F.count("*").alias("chunks"), F.sum("n_chars").alias("size"))


@query("agg16_hit_rate", "WITH c AS (SELECT user_id, count(*) FILTER (event_id % 3 <> 0) AS h, count(*) FILTER (event_id % 3 = 0) AS m FROM events GROUP BY user_id) SELECT user_id, (CASE WHEN h + m > 0 THEN floor(h * 10000.0::DOUBLE / (h + m) + 0.5) / 100 ELSE 0.0 END)::DOUBLE AS hit_rate FROM c")
def agg16_hit_rate(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 3 != 0).alias("h"), F.count_if(F.col("event_id") % 3 == 0).alias("m"))
    return counts.select("user_id", evaluate.hit_rate(F.col("h"), F.col("m")).cast("double").alias("hit_rate"))


@query("agg18_block_rate", "WITH c AS (SELECT user_id, count(*) FILTER (event_id % 9 <> 0) AS a, count(*) FILTER (event_id % 9 = 0) AS b FROM events GROUP BY user_id) SELECT user_id, (floor(b * 10000.0::DOUBLE / greatest(1, a + b) + 0.5) / 100)::DOUBLE AS block_rate FROM c")
def agg18_block_rate(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 9 != 0).alias("a"), F.count_if(F.col("event_id") % 9 == 0).alias("b"))
    return counts.select("user_id", evaluate.block_rate(F.col("a"), F.col("b")).cast("double").alias("block_rate"))


@query("agg19_queue_stats", "SELECT count(*) FILTER (event_type = 'click')::BIGINT AS active, count(*) FILTER (event_type = 'view')::BIGINT AS processed, count(*) FILTER (event_type NOT IN ('click', 'view'))::BIGINT AS rejected FROM events")
def agg19_queue_stats(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").agg(F.count_if(kind == "click").alias("active"), F.count_if(kind == "view").alias("processed"), F.count_if(~kind.isin("click", "view")).alias("rejected"))


def _fold_sql(key: str, where: str, first: str, kept: str, then: str, taken: str, columns: str = "") -> str:
    """Events ``e`` of each key in order, and their decisions ``f`` by recursion: state and decision from the state before."""
    return f"""e AS (SELECT {key} AS key, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS rn FROM events WHERE {where}),
f AS (SELECT key, rn, t, {first} FROM e WHERE rn = 1 UNION ALL SELECT key, rn, t, {then} AS state, {taken} AS taken FROM (SELECT e.key, e.rn, e.t, {kept} AS kept FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1))"""


_LIMIT_SQL = "WITH RECURSIVE " + _fold_sql("user_id::VARCHAR", "user_id IS NOT NULL AND ts IS NOT NULL", "[t] AS state, true AS taken", "list_filter(f.state, lambda s: s > e.t - 7200)", "CASE WHEN len(kept) >= 3 THEN kept ELSE list_append(kept, t) END", "len(kept) < 3")
_QUERY_KEY = "event_type || '-' || (user_id % 7)::VARCHAR"
_HISTORY_SQL = "WITH RECURSIVE " + _fold_sql(_QUERY_KEY, "event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL", "t AS state, true AS taken", "f.state", "CASE WHEN t - kept >= 300 THEN t ELSE kept END", "t - kept >= 300")
_CACHE_SQL = "WITH RECURSIVE " + _fold_sql(_QUERY_KEY, "event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL", "[t, 0.0::DOUBLE] AS state, false AS taken", "f.state", "CASE WHEN t - kept[1] <= 600 * least(2.0::DOUBLE, 1 + 0.1::DOUBLE * greatest(0, kept[2] - 1)) THEN [kept[1], kept[2] + 1] ELSE [t, 0.0::DOUBLE] END", "t - kept[1] <= 600 * least(2.0::DOUBLE, 1 + 0.1::DOUBLE * greatest(0, kept[2] - 1))")
#: A minute's events are decided when the watermark, a minute behind the newest event, has passed its end.
_CLOSED = "(floor(t / 60) + 1) * 60 <= (SELECT max(epoch(ts)) - 60 FROM events)"


@query("str01_rate_limit", f"{_LIMIT_SQL} SELECT key, count(*) FILTER (taken)::BIGINT AS allowed, count(*) FILTER (NOT taken)::BIGINT AS blocked FROM f GROUP BY key")
def str01_rate_limit(spark, sf):
    return limits.rate_limited(table(spark, sf, "events"), key="user_id", at="ts", limit=3, seconds=7200)


@query("str02_history_dedupe", f"{_HISTORY_SQL} SELECT key AS query, count(*) FILTER (taken)::BIGINT AS stored FROM f GROUP BY key")
def str02_history_dedupe(spark, sf):
    return limits.stored_history(_asked(table(spark, sf, "events")), query="query", at="ts")


@query("str04_invalidate", "SELECT doc_id // 40 AS entry, count(*)::BIGINT AS n FROM documents GROUP BY entry HAVING NOT bool_or(coalesce(source = 'src3', false))")
def str04_invalidate(spark, sf):
    """Cached results of searches over forty documents each; those with a hit of the source go."""
    cached = _docs(spark, sf).groupBy(F.floor(F.col("doc_id") / 40).alias("entry")).agg(F.max(F.coalesce(F.col("source") == "src3", F.lit(False))).alias("stale"), F.count("*").alias("n"))
    return cached.filter(~F.col("stale")).select("entry", "n")


@query("set05_distinct_tags", f"WITH {_TAGS} SELECT filename, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY filename")
def set05_distinct_tags(spark, sf):
    return _tags(spark, sf).groupBy("filename").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))


@query("prj12_structure", f"WITH {_TAGS} SELECT source AS name, count(*)::BIGINT AS chunks, sum(n_chars)::BIGINT AS size, (SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM tags WHERE filename = source) AS tags FROM documents GROUP BY source")
def prj12_structure(spark, sf):
    files = _docs(spark, sf).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("size")).withColumn("file_id", file_id("name"))
    return stores.files_with_tags(files, _tags(spark, sf)).select("name", "chunks", "size", F.array_join("tags", ",").alias("tags"))


# Streaming. Each query drains its source once; the driver's tables stand in for a directory of arriving files.


def _drain(spark, stream, mode: str, name: str):
    """Run a stream over what is there and return its rows."""
    run = own_folder(spark, f"stream-{name}")
    out = f"{run}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{run}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").option("path", out).start().awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _asked(events):
    return events.filter("event_type IS NOT NULL AND user_id IS NOT NULL").withColumn("query", F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")))


@query("str01_stream_limiter", f"{_LIMIT_SQL} SELECT key, count(*) FILTER (taken)::BIGINT AS allowed, count(*) FILTER (NOT taken)::BIGINT AS blocked FROM f WHERE {_CLOSED} GROUP BY key")
def str01_stream_limiter(spark, sf):
    with keyed.rocksdb(spark):
        decided = _drain(spark, keyed.limiter(_event_stream(spark, sf), key="user_id", at="ts", limit=3, seconds=7200), "append", "limiter")
    return decided.groupBy("key").agg(F.count_if("taken").alias("allowed"), F.count_if(~F.col("taken")).alias("blocked"))


@query("str02_stream_history", f"{_HISTORY_SQL} SELECT key AS query, count(*) FILTER (taken)::BIGINT AS stored FROM f WHERE {_CLOSED} GROUP BY key")
def str02_stream_history(spark, sf):
    with keyed.rocksdb(spark):
        decided = _drain(spark, keyed.history(_asked(_event_stream(spark, sf)), query="query", at="ts"), "append", "history")
    return decided.groupBy(F.col("key").alias("query")).agg(F.count_if("taken").alias("stored"))


@query("str03_cache", f"{_CACHE_SQL} SELECT key AS query, count(*) FILTER (taken)::BIGINT AS hits, count(*) FILTER (NOT taken)::BIGINT AS misses FROM f WHERE {_CLOSED} GROUP BY key")
def str03_cache(spark, sf):
    """Which searches find their result in a cache whose entries live longer the more they are used."""
    with keyed.rocksdb(spark):
        uses = _drain(spark, keyed.cached(_asked(_event_stream(spark, sf)), key="query", at="ts", ttl=600.0), "append", "cache")
    return uses.groupBy(F.col("key").alias("query")).agg(F.count_if("taken").alias("hits"), F.count_if(~F.col("taken")).alias("misses"))


@query("ext_window_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def ext_window_tumbling(spark, sf):
    rows = _drain(spark, jobs.windows(_event_stream(spark, sf), at="ts", by=("event_type",)), "complete", "windows")
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


@query("ext_window_sliding", "SELECT date_trunc('hour', ts) - INTERVAL (h) HOURS AS start, count(*)::BIGINT AS n FROM events, (VALUES (0), (1)) t(h) GROUP BY ALL")
def ext_window_sliding(spark, sf):
    rows = _drain(spark, jobs.windows(_event_stream(spark, sf), at="ts", size="2 hours", slide="1 hour"), "complete", "sliding")
    return rows.select(F.col("window.start").alias("start"), "n")


@query(
    "ext_session",
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM g GROUP BY user_id, g""",
)
def ext_session(spark, sf):
    rows = _drain(spark, jobs.sessions(_event_stream(spark, sf), key="user_id", at="ts"), "complete", "sessions")
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")
