"""Relational stores as tables: tags, revisions, history, conversations, bookmarks, file registry, index lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanji import config
from hanji.functions.text import strip

# Tags


def set_tags(tags: DataFrame, replaced: DataFrame) -> DataFrame:
    """Tags with those of each file in ``replaced`` (filename, tags array) put in place of the old ones."""
    kept = tags.join(replaced.select("filename"), "filename", "left_anti").select("filename", "tag")
    clean = F.array_distinct(F.filter(F.transform("tags", strip), lambda t: t != ""))
    return kept.unionByName(replaced.select("filename", F.explode(clean).alias("tag")))


def add_tags(tags: DataFrame, added: DataFrame) -> DataFrame:
    return tags.select("filename", "tag").unionByName(added.select("filename", "tag")).dropDuplicates(["filename", "tag"])


def remove_tags(tags: DataFrame, removed: DataFrame) -> DataFrame:
    return tags.join(removed.select("filename", "tag"), ["filename", "tag"], "left_anti")


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("cnt"))


def files_with_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Files with the sorted tags stored under their id or, from before ids, their name.

    Two equi joins instead of one on either key, so that neither becomes a nested loop.
    """
    by_id = files.select("file_id").join(tags.select(F.col("filename").alias("file_id"), "tag"), "file_id")
    by_name = files.select("file_id", "name").join(tags.select(F.col("filename").alias("name"), "tag"), "name").select("file_id", "tag")
    lists = by_id.unionByName(by_name).groupBy("file_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return files.join(lists, "file_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


# Revisions


def next_versions(revisions: DataFrame) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(version, '^(?i)v([0-9]+)$', 1) AS int)")
    return revisions.groupBy("filename").agg(F.concat(F.lit("v"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("next_version"))


def latest_revisions(revisions: DataFrame) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("filename", "version").orderBy(F.col("id").desc()))
    return revisions.withColumn("_n", last).filter("_n = 1").drop("_n")


def revision_name(stem: Column, version: Column, at: Column) -> Column:
    return F.concat(stem, F.lit("_"), version, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".txt"))


# History


def popular(history: DataFrame, limit: int) -> DataFrame:
    return history.groupBy("query").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), "query").limit(limit)


def recent(history: DataFrame, limit: int) -> DataFrame:
    return history.groupBy("query").agg(F.max("ts").alias("last_ts")).orderBy(F.col("last_ts").desc(), "query").limit(limit)


def suggest(history: DataFrame, prefix: str, limit: int) -> DataFrame:
    return recent(history.filter(F.col("query").like(prefix + "%")), limit)


# Conversations


def last_turns(messages: DataFrame, items: int = config.HISTORY_ITEMS, chars: int = config.HISTORY_CHARS) -> DataFrame:
    """The last items of each conversation, of which users' and assistants' remain, cut to a length."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return messages.withColumn("_n", n).filter(F.col("_n") <= items).filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", F.substring("text", 1, chars).alias("content"))


def conversation_documents(messages: DataFrame) -> DataFrame:
    """One row per conversation with its messages in order, as an array and as Markdown."""
    together = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    line = F.transform("messages", lambda m: F.concat(F.lit("## "), m["role"], F.lit("\n\n"), m["text"], F.lit("\n")))
    return together.select("conv_id", "messages", F.substring(F.element_at("messages", 1)["text"], 1, 40).alias("title"), F.array_join(line, "\n").alias("markdown"))


def parsed_citations(raw: Column) -> Column:
    kind = "array<struct<index:int,source:string,excerpt:string>>"
    return F.coalesce(F.from_json(raw, kind), F.array().cast(kind))


def visible(conversations: DataFrame, owned: DataFrame | None) -> DataFrame:
    """All for an administrator (``owned`` None), else those owned."""
    return conversations if owned is None else conversations.join(owned.select("conv_id"), "conv_id", "left_semi")


def claimed(claims: DataFrame, most: int = 100) -> DataFrame:
    """The latest claims of each session."""
    n = F.row_number().over(Window.partitionBy("session").orderBy(F.col("at").desc(), "conv_id"))
    return claims.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


# Bookmarks


def bookmarks(rows: DataFrame, most: int = 50) -> DataFrame:
    """Newest first, one for each first hundred characters, at most fifty."""
    n = F.row_number().over(Window.partitionBy(F.substring("content", 1, 100)).orderBy(F.col("ts").desc(), "id"))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n").orderBy(F.col("ts").desc(), "id").limit(most)


# Files and index lifecycle


def manifest_diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each listed file with action cached or process; files gone from the listing with action removed."""
    old = manifest.select("key", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    now = listing.join(old, "key", "left").select("key", F.when(F.coalesce(same, F.lit(False)), "cached").otherwise("process").alias("action"))
    gone = manifest.join(listing.select("key"), "key", "left_anti").select("key", F.lit("removed").alias("action"))
    return now.unionByName(gone)


def merged_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)


def without_files(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks but those of removed files: by path, by id, or by source for chunks without either. Three equi joins."""
    r = removed.select("path", "file_id", "source")
    left = chunks.join(r.filter("path <> ''").select("path").distinct(), "path", "left_anti")
    left = left.join(r.filter("file_id <> ''").select("file_id").distinct(), "file_id", "left_anti")
    nameless = left.filter("coalesce(path, '') = '' AND coalesce(file_id, '') = ''")
    named = left.filter("NOT (coalesce(path, '') = '' AND coalesce(file_id, '') = '')")
    return named.unionByName(nameless.join(r.select("source").distinct(), "source", "left_anti").select(*named.columns))


def files_by_name(files: DataFrame, name: str):
    """The one file of that name; LookupError for none or several."""
    found = files.filter(F.col("name") == name).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{len(found) or 'no'} files are named {name}" if not found else f"several files are named {name}")
    return found[0]


def first_of_file(chunks: DataFrame, most: int = 200) -> DataFrame:
    """The first chunk of each file (or source), at most two hundred."""
    key = F.when(F.coalesce("file_id", F.lit("")) != "", F.col("file_id")).otherwise(F.col("source"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("doc_id"))
    return chunks.withColumn("_n", n).filter("_n = 1").drop("_n").orderBy("doc_id").limit(most)


def page(rows: DataFrame, order: list[str], number: int, size: int) -> tuple[DataFrame, dict]:
    """One page and its envelope. Only the rows up to the page's end are ordered."""
    total = rows.count()
    n = F.row_number().over(Window.orderBy(*order))
    shown = rows.orderBy(*order).limit(number * size).withColumn("_n", n).filter(F.col("_n") > (number - 1) * size).drop("_n")
    return shown, {"page": number, "per_page": size, "total": total, "total_pages": -(-total // size) if size else 0}


# Exports


def _joined(hits: DataFrame, block, by: list[str] | None) -> DataFrame:
    """The blocks of each result list in rank order, as one text."""
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    return hits.groupBy(*(by or [])).agg(F.array_join(blocks, "\n").alias("export"))


def _percent():
    return F.floor(F.col("score") * 100 + 0.5).cast("int")


def export_text(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each result list in ``by``; without it, all hits are one list."""
    return _joined(hits, F.format_string("[%d] %s (%d%%)\n%s\n", F.col("rank"), F.col("source"), _percent(), F.col("text")), by)


def export_markdown(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _joined(hits, F.format_string("## %d. %s (%d%%)\n\n%s\n", F.col("rank"), F.col("source"), _percent(), F.col("text")), by)


def export_json(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    item = F.struct("rank", "source", _percent().alias("score"), F.col("text").alias("content"))
    return hits.groupBy(*(by or [])).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("export"))
