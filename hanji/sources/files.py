"""File sources: folder scans, ZIP archives, manifests and their integrity, settings and golden queries."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanji import config
from hanji.functions.text import allowed_file, file_id
from hanji.sources.extract import safe_name


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, file_id, modificationTime, length, content) of all supported files below a folder.

    Endings are compared without case after listing; the content is only read where a later step asks for it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.filter(allowed_file("name")).withColumn("file_id", file_id("path"))


def listing(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(key, size, mtime): keys are paths relative to the root."""
    root = (root or path).rstrip("/") + "/"
    files = folder(spark, path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return files.select(F.regexp_replace("path", "^(?:file:/*/)?\\Q" + root.lstrip("/") + "\\E", "").alias("key"), "size", "mtime")


MEMBERS = "archive string, member string, name string, status string, reason string, content binary"


def zip_members(path: str, file, first: int = 0, last: int | None = None, *, entries=config.ZIP_ENTRIES, total=config.ZIP_TOTAL, single=config.ZIP_SINGLE, wanted=None) -> Iterator[tuple]:
    """Rows of :data:`MEMBERS` of the members with numbers from ``first`` up to ``last``, of an open ZIP archive.

    Extracted, skipped or failed, with names flattened and made unique in the archive. Sizes are held to the limits as
    declared and as read; a member outside its archive's folder fails. An archive that cannot be read, or is beyond the
    limits, is one failed row, of the first range. ``wanted`` tells which members are to be unpacked and returned.
    """
    try:
        z = zipfile.ZipFile(file)
    except zipfile.BadZipFile as e:
        if not first:
            yield path, None, None, "failed", str(e), None
        return
    used: set[str] = set()
    with z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > entries or sum(i.file_size for i in infos) > total:
            if not first:
                yield path, None, None, "failed", "archive exceeds its limits", None
            return
        for number, info in enumerate(infos[:last]):
            inside = info.filename.replace("\\", "/")
            mine, fault = number >= first and (wanted is None or wanted(info.filename)), None
            if inside.startswith("/") or ".." in inside.split("/") or ":" in inside.split("/")[0]:
                fault = "failed", "path leaves the archive"
            elif posixpath.splitext(inside)[1].lower() not in config.EXTENSIONS:
                fault = "skipped", "format"
            elif info.file_size > single:
                fault = "failed", "member is too large"
            if fault:
                if mine:
                    yield path, info.filename, None, *fault, None
                continue
            name = safe_name(inside)
            stem, ending = posixpath.splitext(name)
            n = 0
            while name.lower() in used and n < 999:
                n += 1
                name = f"{stem}_{n}{ending}"
            free = name.lower() not in used
            used.add(name.lower())
            if not mine:
                continue
            if not free:
                yield path, info.filename, None, "failed", "no free name is left", None
                continue
            try:
                with z.open(info) as f:
                    data = f.read(single + 1)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                yield path, info.filename, None, "failed", str(e), None
                continue
            if len(data) > min(single, info.file_size):
                yield path, info.filename, None, "failed", "member is larger than declared", None
            else:
                yield path, info.filename, name, "success", None, data


def archive_members(archives: DataFrame, **limits) -> DataFrame:
    """Members of ZIP archives (path, content) that are in memory; see :func:`zip_members`. For stored ones, see :class:`hanji.sources.connectors.ZipMembers`."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                for row in zip_members(p, io.BytesIO(bytes(c)), **limits):
                    yield pd.DataFrame([row], columns=[x.split()[0] for x in MEMBERS.split(", ")])

    return archives.select("path", "content").mapInPandas(work, MEMBERS)


def archive_totals(members: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return members.groupBy("archive").agg(count("success"), count("failed"), count("skipped"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("bytes"))


MANIFEST_KEYS = ("model", "backend", "normalize", "chunk_size", "chunk_overlap", "vector_weight", "bm25_weight", "key_mode")


def save_manifest(spark: SparkSession, path: str, values: dict) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True, ensure_ascii=False),)], "manifest string").coalesce(1).write.mode("overwrite").text(path)


def usable_manifest(spark: SparkSession, path: str, wanted: dict) -> bool:
    """Whether an index written under ``path`` was made with the same settings; any other is to be rebuilt."""
    try:
        rows = spark.read.text(path).limit(1).collect()
    except Exception:  # no index yet
        return False
    have = json.loads(rows[0][0]) if rows else {}
    return bool(rows) and all(have.get(k) == wanted.get(k) for k in MANIFEST_KEYS)


def integrity(files: DataFrame) -> DataFrame:
    """(path, size, sha256)."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def damaged(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored entries that are gone or differ."""
    n = now.select("path", F.col("size").alias("s"), F.col("sha256").alias("h"))
    joined = stored.join(n, "path", "left")
    return joined.filter(~F.coalesce((F.col("s") == F.col("size")) & (F.col("h") == F.col("sha256")), F.lit(False))).select("path")


STATS = "path string, name string, extension string, size long, status string, chunks int, error string, mod_time double, version string, file_id string"


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Stored file records; missing fields get their defaults."""
    rows = spark.read.schema(STATS).json(path)
    base = F.element_at(F.split("path", "/"), -1)
    return rows.select(
        "path", F.coalesce("name", base).alias("name"), F.coalesce("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).alias("extension"),
        F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("status", F.lit(config.STATUSES[0])).alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("error", F.lit("")).alias("error"), F.coalesce("mod_time", F.lit(0.0)).alias("mod_time"), "version", F.coalesce("file_id", file_id("path")).alias("file_id"),
    )


def save_file_stats(records: DataFrame, path: str) -> None:
    """Write file records as JSON lines that :func:`file_stats` reads; fields that ``records`` lacks are left out."""
    records.select(*[c for c in (field.split()[0] for field in STATS.split(", ")) if c in records.columns]).write.mode("overwrite").json(path)


def goldens(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries with the file's defaults filled in."""
    kind = "defaults struct<k:int,hybrid:boolean>, queries array<struct<query:string,category:string,k:int,hybrid:boolean,filter_file:string,filter_file_id:string,expected:map<string,string>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select("defaults", F.posexplode("queries").alias("query_id", "q"))
    return rows.select(
        "query_id", "q.query", "q.category", F.coalesce("q.k", "defaults.k").alias("k"), F.coalesce("q.hybrid", "defaults.hybrid").alias("hybrid"), "q.filter_file", "q.filter_file_id", "q.expected"
    )


def safe_folder(path: str, roots: list[str]) -> str:
    """A normalized path inside one of the roots; ValueError otherwise."""
    if not path or ".." in path.replace("\\", "/").split("/") or "//" in path.replace("://", ""):
        raise ValueError(f"not allowed: {path}")
    norm = posixpath.normpath(path)
    if not any(norm == r.rstrip("/") or norm.startswith(r.rstrip("/") + "/") for r in roots):
        raise ValueError(f"outside the allowed folders: {path}")
    return norm
