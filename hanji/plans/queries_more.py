"""Registered queries on sources, sinks, set operations, remaining functions, and the composed pipeline."""

from __future__ import annotations

import io

from pyspark.sql import Window
from pyspark.sql import functions as F

from hanji import config
from hanji.functions import text as T
from hanji.operators import grounding, index, retrieve, segments, stores
from hanji.plans.catalogue import query, table
from hanji.plans.queries_search import TERMS, _bm25_sql
from hanji.sources import connectors
from hanji.sources.versions import own_folder
from hanji.streaming import jobs


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _archives(spark, sf) -> str:
    """Documents in ZIP archives of forty, under names that are to be flattened, made unique, skipped or refused."""
    folder = own_folder(spark, "archives")

    def pack(frame):
        import zipfile

        import pandas as pd
        from pyarrow import fs

        part = int(frame["part"].iloc[0])
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for doc_id, text in sorted(zip(frame["doc_id"], frame["text"], strict=True)):
                z.writestr((f"d{doc_id}.txt", "a/same.txt", f"../evil{doc_id}.txt", f"skip{doc_id}.exe", f"x/y/d{doc_id}.docx")[doc_id % 5], text)
        with store.open_output_stream(f"{base}/z{part}.zip", compression=None) as file:
            file.write(out.getvalue())
        return pd.DataFrame({"part": [part], "bytes": [len(out.getvalue())]})

    rows = _docs(spark, sf).filter("text IS NOT NULL").select(F.floor(F.col("doc_id") / 40).alias("part"), "doc_id", "text")
    rows.groupBy("part").applyInPandas(pack, "part long, bytes long").agg(F.sum("bytes")).collect()
    return folder


_MEMBERS_SQL = """m AS (SELECT doc_id // 40 AS part, doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'd' || doc_id || '.txt' WHEN 1 THEN 'a/same.txt' WHEN 2 THEN '../evil' || doc_id || '.txt' WHEN 3 THEN 'skip' || doc_id || '.exe' ELSE 'x/y/d' || doc_id || '.docx' END AS member,
  CASE doc_id % 5 WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' ELSE 'success' END AS status, row_number() OVER (PARTITION BY doc_id // 40, doc_id % 5 ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL)"""


def _part(archive: str):
    return F.regexp_extract(archive, r"z(\d+)\.zip$", 1).cast("long").alias("part")


@query("src15_zip", f"WITH {_MEMBERS_SQL} SELECT part, member, CASE doc_id % 5 WHEN 0 THEN member WHEN 1 THEN 'same' || CASE WHEN r > 1 THEN '_' || (r - 1) ELSE '' END || '.txt' WHEN 4 THEN 'd' || doc_id || '.docx' END AS name, status, CASE WHEN status = 'success' THEN md5(text) END AS h FROM m")
def src15_zip(spark, sf):
    """Archives of all documents, read back by ranges of members."""
    connectors.register(spark)
    found = spark.read.format("zip_members").load(_archives(spark, sf))
    return found.select(_part("archive"), "member", "name", "status", F.md5("content").alias("h"))


@query("agg29_zip_totals", f"WITH {_MEMBERS_SQL} SELECT part, count(*) FILTER (status = 'success')::BIGINT AS success, count(*) FILTER (status = 'failed')::BIGINT AS failed, count(*) FILTER (status = 'skipped')::BIGINT AS skipped, coalesce(sum(strlen(text)) FILTER (status = 'success'), 0)::BIGINT AS bytes FROM m GROUP BY part")
def agg29_zip_totals(spark, sf):
    from hanji.sources.files import archive_totals

    connectors.register(spark)
    return archive_totals(spark.read.format("zip_members").load(_archives(spark, sf))).select(_part("archive"), "success", "failed", "skipped", "bytes")


@query("src01_folder_scan", "SELECT source, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) GROUP BY source")
def src01_folder_scan(spark, sf):
    """Documents written as text files, a folder a source, among files of other kinds; scanned, filtered by ending, and read."""
    from hanji.sources.files import folder

    path = own_folder(spark)
    rows = _docs(spark, sf).filter("text IS NOT NULL AND source IS NOT NULL")
    rows.select("source", "text").write.partitionBy("source").text(f"{path}/texts")
    rows.select("doc_id").write.json(f"{path}/others")
    found = folder(spark, path).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.split(F.regexp_replace(F.col("content").cast("string"), r"\n\z", ""), "\n").alias("lines"))
    return found.select("source", F.explode("lines").alias("line")).groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("src16_index_cache", f"SELECT doc_id, len(regexp_extract_all(lower(text), '{T.TOKEN}'))::BIGINT AS dl FROM documents")
def src16_index_cache(spark, sf):
    from hanji.sources.files import save_manifest, usable_manifest

    path, made = own_folder(spark), {"model": "hash", "chunk_size": 800}
    index.build(_docs(spark, sf)).save(path)
    save_manifest(spark, f"{path}/manifest", made)
    if not usable_manifest(spark, f"{path}/manifest", made) or usable_manifest(spark, f"{path}/manifest", made | {"chunk_size": 500}):
        raise AssertionError("the manifest does not tell settings apart")
    return index.Index.load(spark, path).doc_stats


@query("snk01_index_search", "SELECT count(*)::BIGINT AS n FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣_]{2,}'), lambda t: t IN ('licensed', 'erin'))) > 0")
def snk01_index_search(spark, sf):
    path = own_folder(spark)
    index.build(_docs(spark, sf)).save(path)
    return index.search(index.Index.load(spark, path), ["licensed", "erin"]).agg(F.count("*").alias("n"))


@query("src17_integrity", "SELECT doc_id AS path FROM documents WHERE doc_id % 10 = 4 OR doc_id % 10 = 7")
def src17_integrity(spark, sf):
    from hanji.sources.files import damaged, integrity

    rows = _docs(spark, sf).select(F.col("doc_id").alias("path"), F.length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    changed = rows.filter("path % 10 <> 7").withColumn("content", F.when(F.col("path") % 10 == 4, F.lit("x").cast("binary")).otherwise(F.col("content")))
    return damaged(integrity(changed), integrity(rows))


_PAGES = "(SELECT doc_id // 40 AS page, doc_id % 101 AS percent, coalesce(source, 'x') AS source, doc_id, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS r FROM documents)"


def _result_pages(spark, sf):
    """All documents as the ranked results of searches with forty hits."""
    page = F.floor(F.col("doc_id") / 40).alias("page")
    rows = _docs(spark, sf).select(page, F.coalesce("source", F.lit("x")).alias("source"), ((F.col("doc_id") % 101) / 100.0).alias("score"), F.col("doc_id").cast("string").alias("text"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("doc_id")))


@query("snk06_export_json", f"""SELECT page, '[' || string_agg('{{"rank":' || r || ',"source":"' || source || '","score":' || percent || ',"content":"' || doc_id || '"}}', ',' ORDER BY r) || ']' AS export FROM {_PAGES} GROUP BY page""")
def snk06_export_json(spark, sf):
    return stores.export_json(_result_pages(spark, sf), by=["page"])


@query("snk06_export_markdown", f"SELECT page, string_agg('## ' || r || '. ' || source || ' (' || percent || '%)' || chr(10) || chr(10) || doc_id || chr(10), chr(10) ORDER BY r) AS export FROM {_PAGES} GROUP BY page")
def snk06_export_markdown(spark, sf):
    return stores.export_markdown(_result_pages(spark, sf), by=["page"])


@query("snk06_export_text", f"SELECT page, string_agg('[' || r || '] ' || source || ' (' || percent || '%)' || chr(10) || doc_id || chr(10), chr(10) ORDER BY r) AS export FROM {_PAGES} GROUP BY page")
def snk06_export_text(spark, sf):
    return stores.export_text(_result_pages(spark, sf), by=["page"])


@query("snk08_conversation_json", "SELECT conv_id, count(*)::BIGINT AS n, min(turn) AS first_turn FROM conversations GROUP BY conv_id")
def snk08_conversation_json(spark, sf):
    made = stores.conversation_documents(table(spark, sf, "conversations")).select("conv_id", F.to_json("messages").alias("j"))
    back = F.from_json("j", "array<struct<turn:long,role:string,text:string>>")
    return made.select("conv_id", F.size(back).cast("long").alias("n"), F.get(back, F.lit(0))["turn"].alias("first_turn"))


@query("jn03_lookup", "SELECT e.vec_id AS doc_id, d.source, d.lang FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def jn03_lookup(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")).join(_docs(spark, sf).select("doc_id", "source", "lang"), "doc_id")


@query("jn04_resolve_duplicates", "SELECT doc_id, min(doc_id) OVER (PARTITION BY source, text) AS resolved FROM documents")
def jn04_resolve_duplicates(spark, sf):
    # Grouped by a digest, so that texts are not shuffled.
    rows = _docs(spark, sf).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = rows.groupBy("source", "h").agg(F.min("doc_id").alias("resolved"))
    return rows.join(first, ["source", "h"]).select("doc_id", "resolved")


@query("jn05_claim_overlap", r"WITH ev AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '\s+')) AS w FROM benchmark), cl AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents) SELECT doc_id, count(*)::BIGINT AS overlap FROM cl WHERE length(w) > 1 AND w IN (SELECT w FROM ev) GROUP BY doc_id")
def jn05_claim_overlap(spark, sf):
    evidence = table(spark, sf, "benchmark").select(F.explode(grounding.words(F.col("text"))).alias("w")).distinct()
    words = _docs(spark, sf).select("doc_id", F.explode(grounding.words(F.col("text"))).alias("w")).filter(F.length("w") > 1)
    return words.join(evidence, "w", "left_semi").groupBy("doc_id").agg(F.count("*").alias("overlap"))


@query("jn11_contains_words", "SELECT doc_id, (CASE WHEN contains(lower(text), 'erin') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'licen') THEN 1 ELSE 0 END)::INT AS overlap FROM documents")
def jn11_contains_words(spark, sf):
    low = F.lower("text")
    return _docs(spark, sf).select("doc_id", F.size(F.filter(F.array(F.lit("erin"), F.lit("licen")), lambda w: low.contains(w))).alias("overlap"))


@query("agg24_diff_counts", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(w) - (w[len(w)] = '')::INT AS n FROM l) SELECT doc_id AS key, (doc_id % 4 + (n > 0)::INT)::INT AS added, (n > 0)::INT AS removed, (doc_id % 4 + 2 * (n > 0)::INT)::INT AS total FROM n""")
def agg24_diff_counts(spark, sf):
    """Every document and a version of it whose first line is another and that ends with up to three more."""
    from hanji.operators import line_diff

    docs = _docs(spark, sf).filter("text IS NOT NULL")
    first = F.expr("regexp_replace(text, '^[^\\n]*', '\u0001 first')")
    body = F.when(F.size(line_diff.lines("text")) == 0, "").otherwise(F.concat(F.regexp_replace(first, r"\n\z", ""), F.lit("\n")))
    more = F.expr("repeat('\u0001 more\n', cast(doc_id % 4 as int))")
    pairs = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("old"), F.concat(body, more).alias("new"))
    return line_diff.counts(pairs)



@query("win08_first_occurrence", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def win08_first_occurrence(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("top07_recent_limit", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 25")
def top07_recent_limit(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts").orderBy(F.col("ts").desc(), "event_id").limit(25)


@query("top10_k_clamp", "SELECT event_id, greatest(1, least(event_id - 5, 10))::BIGINT AS k FROM events")
def top10_k_clamp(spark, sf):
    return table(spark, sf, "events").select("event_id", F.greatest(F.lit(1), F.least(F.col("event_id") - 5, F.lit(10))).cast("long").alias("k"))


@query("set01_union_distinct", "SELECT conv_id, len(list_distinct(flatten(list(string_split(text, ' ')))))::INT AS n FROM conversations GROUP BY conv_id")
def set01_union_distinct(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", F.split("text", " ").alias("w"))
    return words.groupBy("conv_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("w")))).alias("n"))


@query("set03_evidence_union", r"SELECT count(DISTINCT w)::BIGINT AS n FROM (SELECT unnest(string_split_regex(lower(text), '\s+')) AS w FROM benchmark UNION ALL SELECT lower(regexp_replace(text, '\s+', '', 'g')) FROM benchmark) WHERE w <> ''")
def set03_evidence_union(spark, sf):
    tokens = table(spark, sf, "benchmark").select(F.explode(grounding.evidence_tokens(F.array("text"))).alias("w"))
    return tokens.distinct().agg(F.count("*").alias("n"))


@query("sf27_relative_key", "SELECT page_id, regexp_replace(url, '^https?://', '') AS key FROM pages")
def sf27_relative_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("key"))


@query("sf40_prompt", "SELECT doc_id, '다음은 사내 규정 발췌 내용입니다.' || chr(10) || chr(10) || source || chr(10) || chr(10) || '질문: ' || substr(text, 1, 4000) || chr(10) || chr(10) || '위 컨텍스트만 근거로 답변하고, 각 주장 뒤에 [번호] 인용을 붙이세요.' AS prompt FROM documents")
def sf40_prompt(spark, sf):
    return _docs(spark, sf).select("doc_id", grounding.prompt(F.col("text"), F.col("source")).alias("prompt"))


@query("flt08_date_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def flt08_date_range(spark, sf):
    return table(spark, sf, "events").filter(F.col("ts").between(F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-12 00:00:00'"))).select("event_id")


@query("sf51_cosine", "SELECT a.vec_id AS doc_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2")
def sf51_cosine(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    half = v.select(F.floor(F.col("vec_id") / 2).alias("h"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("a"))
    return half.join(v.select(F.col("vec_id").alias("h"), F.col("embedding").alias("b")), "h").select("doc_id", F.round(retrieve.dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query("sf60_recent_window", "SELECT count(*)::BIGINT AS n FROM events WHERE ts > TIMESTAMP '2024-01-15 12:05:00' - INTERVAL 5 MINUTES AND ts <= TIMESTAMP '2024-01-15 12:05:00'")
def sf60_recent_window(spark, sf):
    now = "TIMESTAMP_NTZ '2024-01-15 12:05:00'"
    return table(spark, sf, "events").filter(f"ts > {now} - INTERVAL 5 MINUTES AND ts <= {now}").agg(F.count("*").alias("n"))


@query("sf72_citations_dump", """SELECT doc_id, '{"index":' || doc_id || ',"source":"' || source || '","note":"규정"}' AS j FROM documents""")
def sf72_citations_dump(spark, sf):
    return _docs(spark, sf).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("index"), "source", F.lit("규정").alias("note"))).alias("j"))


@query("sf73_title", "SELECT conv_id, turn, substr(text, 1, 40) AS title FROM conversations")
def sf73_title(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.substring("text", 1, 40).alias("title"))


_FILE = "'/d/' || coalesce(source, 'x') || '/' || (doc_id // 100)"


@query("prj01_chunk_meta", f"SELECT doc_id, source, {_FILE} AS path, substr(sha1({_FILE}), 1, 24) AS file_id, (row_number() OVER (PARTITION BY {_FILE} ORDER BY doc_id) - 1)::INT AS chunk_id, (count(*) OVER (PARTITION BY {_FILE}))::INT AS total_chunks FROM documents")
def prj01_chunk_meta(spark, sf):
    """Documents as chunks of files that hold a hundred numbers of one source."""
    rows = _docs(spark, sf).withColumn("path", F.concat(F.lit("/d/"), F.coalesce("source", F.lit("x")), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string")))
    by_file = Window.partitionBy("path")
    return rows.select(
        "doc_id", "source", "path", T.file_id("path").alias("file_id"), (F.row_number().over(by_file.orderBy("doc_id")) - 1).cast("int").alias("chunk_id"), F.count("*").over(by_file).cast("int").alias("total_chunks")
    )


@query("prj02_meta_defaults", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'given' WHEN regexp_extract(url, '([^/]+)$', 1) <> '' THEN regexp_extract(url, '([^/]+)$', 1) ELSE '?' END AS source, substr(sha1(url), 1, 24) AS file_id FROM pages")
def prj02_meta_defaults(spark, sf):
    base = F.regexp_extract("url", "([^/]+)$", 1)
    given = F.when(F.col("page_id") % 3 == 0, "given").otherwise("")
    source = F.coalesce(F.nullif(given, F.lit("")), F.nullif(base, F.lit("")), F.lit("?"))
    return table(spark, sf, "pages").select("page_id", source.alias("source"), T.file_id("url").alias("file_id"))


@query("prj09_file_record", "SELECT page_id, url AS path, length(html)::BIGINT AS size, '완료' AS status FROM pages")
def prj09_file_record(spark, sf):
    record = F.to_json(F.struct(F.col("url").alias("path"), F.length("html").cast("long").alias("size"), F.lit("완료").alias("status")))
    back = F.from_json(record, "path string, size long, status string")
    return table(spark, sf, "pages").select("page_id", back.alias("r")).select("page_id", "r.*")


@query("ml01_embed")
def ml01_embed(spark, sf):
    from hanji.plans.engine import HashEmbedder, vectors

    made = vectors(_docs(spark, sf).select("doc_id", "text"), HashEmbedder())
    return made.select("doc_id", F.round(retrieve.l2_norm(F.col("embedding")), 4).alias("norm"))


_FINAL = f"CASE WHEN turn % 4 = 1 THEN '{config.REFUSAL}' ELSE text END"
_WORDS = r"regexp_extract_all(text, '\S+\s*|\s+')"


@query(
    "str08_answer_events",
    f"""WITH a AS (SELECT conv_id, turn, text, {_FINAL} AS final, {_WORDS} AS w FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
e AS (SELECT conv_id, turn, 0 AS seq, 'meta' AS event, '1' AS data FROM a UNION ALL SELECT conv_id, turn, 1, 'citation', conv_id::VARCHAR FROM a
  UNION ALL SELECT conv_id, turn, 1 + i, 'token', w[i] FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM a) UNION ALL SELECT conv_id, turn, 2 + len(w), 'replace', final FROM a WHERE final <> text
  UNION ALL SELECT conv_id, turn, 2 + len(w) + (final <> text)::INT, 'done', final FROM a)
SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, seq::INT AS seq, event, data FROM e""",
)
def str08_answer_events(spark, sf):
    """Every assistant's message as a streamed answer; the batch is run a second time, as after a crash before its commit."""
    base = own_folder(spark)
    schema = table(spark, sf, "conversations").schema
    said = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/conversations.parquet*").filter("role = 'assistant' AND text IS NOT NULL")
    answers = said.select("conv_id", "turn", F.col("text").alias("said"), F.expr(_FINAL).alias("final"), F.array(F.col("conv_id").cast("string")).alias("citations"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for _ in range(2):
        jobs.send_events(answers, f"{base}/log", f"{base}/state").awaitTermination()
        commits = hadoop(f"{base}/state/commits")
        commits.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commits, True)
    return connectors.events(spark, f"{base}/log", jobs.EVENTS)



def _write_texts(rows, folder: str) -> None:
    """Documents as lines of text files, a folder a source."""
    rows.select("source", "text").write.mode("append").partitionBy("source").text(folder)


def _lines(read):
    """(path, line, text) of the lines of text files."""
    content = F.regexp_replace(F.col("content").cast("string"), r"\n\z", "")
    return read.select("path", F.posexplode(F.split(content, "\n")).alias("line", "text"))


def _source(path: str = "path"):
    return F.regexp_extract(path, "source=([^/]+)/", 1).alias("source")


@query("str07_incremental_ingest", "SELECT source, count(*)::BIGINT AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) GROUP BY source")
def str07_incremental_ingest(spark, sf):
    """Files of all documents that arrive in two halves; each call reads those that are new."""
    base, rows = own_folder(spark), _docs(spark, sf).filter("text IS NOT NULL AND source IS NOT NULL")
    for half in (0, 1):
        _write_texts(rows.filter(F.col("doc_id") % 2 == half), f"{base}/in")
        jobs.incremental_ingest(spark, f"{base}/in", f"{base}/chunks", f"{base}/state", lambda read: read, _lines).awaitTermination()
    return spark.read.parquet(f"{base}/chunks").groupBy(_source()).agg(F.count("*").alias("n"))


def _refreshed(spark, sf, after=lambda target: None) -> str:
    """Files of the documents with even numbers; then one source's files go and those of odd numbers come."""
    base, rows = own_folder(spark), _docs(spark, sf).filter("text IS NOT NULL AND source IS NOT NULL")
    _write_texts(rows.filter("doc_id % 2 = 0"), f"{base}/in")
    jobs.refresh(spark, f"{base}/in", f"{base}/index", lambda read: read, _lines)
    after(f"{base}/index")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    hadoop(f"{base}/in").getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(f"{base}/in/source=src1"), True)
    _write_texts(rows.filter("doc_id % 2 = 1").withColumn("source", F.concat("source", F.lit("-b"))), f"{base}/in")
    jobs.refresh(spark, f"{base}/in", f"{base}/index", lambda read: read, _lines)
    after(f"{base}/index")
    return f"{base}/index"


_LEFT = "SELECT doc_id, source, CASE doc_id % 2 WHEN 0 THEN source ELSE source || '-b' END AS folder, text FROM main.documents WHERE text IS NOT NULL AND source IS NOT NULL AND (doc_id % 2 = 1 OR source <> 'src1')"


@query("str07_refresh", f"SELECT source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT folder AS source, unnest(string_split(text, chr(10))) AS text FROM ({_LEFT})) GROUP BY source")
def str07_refresh(spark, sf):
    return jobs.current(spark, _refreshed(spark, sf)).groupBy(_source()).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("src21_change_stream", "SELECT DISTINCT 1 AS version, 'process' AS action, source FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id % 2 = 0 UNION ALL SELECT DISTINCT 2, 'removed', source FROM documents WHERE source = 'src1' AND text IS NOT NULL AND doc_id % 2 = 0 UNION ALL SELECT DISTINCT 2, 'process', source || '-b' FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id % 2 = 1")
def src21_change_stream(spark, sf):
    """Created and deleted files as a stream whose offsets are the versions of the refreshed folder."""
    connectors.register(spark)
    out = own_folder(spark)

    def drain(target: str) -> None:
        changes = spark.readStream.format("file_changes").load(target)
        changes.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()

    _refreshed(spark, sf, drain)
    return spark.read.parquet(f"{out}/rows").select("version", "action", _source()).distinct()


_LINES_SQL = _bm25_sql(TERMS).replace("FROM documents)", "FROM lines)", 1)


@query("str07_index_follows", f"WITH lines AS (SELECT row_number() OVER () AS doc_id, text FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM ({_LEFT}))), {_LINES_SQL} SELECT md5(text) AS h, score FROM bm25 JOIN lines USING (doc_id)")
def str07_index_follows(spark, sf):
    """An index of lines that follows each refresh: what it finds at the end is what an index of the files left finds."""
    at = own_folder(spark, "segments")
    line_id = lambda: F.concat_ws("#", "path", F.col("line").cast("string"))
    target = _refreshed(spark, sf, lambda t: jobs.follow(segments.SegmentIndex(spark, at), t, line_id))
    found = segments.SegmentIndex(spark, at).search(TERMS).select("doc_id", F.round("score", 6).alias("score"))
    return jobs.current(spark, target).select(line_id().alias("doc_id"), F.md5("text").alias("h")).join(found, "doc_id").select("h", "score")
