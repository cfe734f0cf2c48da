"""Structured Streaming jobs: incremental ingest, refresh of changed files, search-log windows and sessions, answer events.

Jobs with keyed state of their own are in :mod:`hanji.streaming.keyed`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hanji.operators import stores
from hanji.operators.segments import SegmentIndex
from hanji.sources import connectors, files
from hanji.sources.versions import Versions


def file_stream(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windows(searches: DataFrame, *, at: str, size: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Searches counted in tumbling or sliding windows of event time."""
    timed = searches.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    return timed.groupBy(F.window("_at", size, slide) if slide else F.window("_at", size), *by).agg(F.count("*").alias("n"))


def sessions(searches: DataFrame, *, key: str, at: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    timed = searches.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    return timed.groupBy(F.session_window("_at", gap), key).agg(F.count("*").alias("n"))


def incremental_ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame]):
    """Start a job that extracts and chunks files as they appear; returns the query. ``stop()`` cancels it.

    Each batch is a partition of its own that a replay overwrites, so a replayed batch does not add rows twice. Files
    that change or go are not seen: see :func:`refresh`.
    """
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        chunk(extract(batch)).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(spark: SparkSession, folder: str, target: str, extract: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Bring ``target`` up to a folder's new, changed and deleted files; returns how many were processed, cached, removed.

    Each call adds a version (:mod:`hanji.sources.versions`): the chunks of the files it processed, a manifest that names for
    every file the load with its chunks, and the list of changes. Nothing older is rewritten; chunks of changed and deleted
    files are simply named no longer. A call that breaks off leaves the version before as it is, and of two that race one
    fails. Only files to be processed are read; their paths pass the driver, which has listed the folder anyway. ``chunk``
    must keep ``path``. A file that goes while it is read fails the call.
    """
    versions, load = Versions(spark, target), uuid.uuid4().hex
    number, state = versions.newest()
    listing = files.folder(spark, folder).select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    manifest = spark.read.parquet(f"{target}/manifest/{state['load']}") if number else listing.withColumn("load", F.lit("")).limit(0)
    actions = stores.manifest_diff(listing, manifest).persist()
    known = manifest.select("key", F.col("load").alias("known"))
    listed = listing.join(actions, "key").join(known, "key", "left")
    todo = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["key"]) for r in actions.filter("action = 'process'").select("key").collect()]
    read = spark.read.format("binaryFile").load(todo) if todo else files.folder(spark, folder).limit(0)
    chunk(extract(read)).write.parquet(f"{target}/chunks/load={load}")
    listed.select("key", "size", "mtime", F.when(F.col("action") == "cached", F.col("known")).otherwise(F.lit(load)).alias("load")).write.parquet(f"{target}/manifest/{load}")
    actions.filter("action <> 'cached'").select(F.col("key").alias("path"), "action").write.parquet(f"{target}/changes/{load}")
    versions.commit(number, {"load": load})
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    actions.unpersist()
    return {action: counts.get(action, 0) for action in ("process", "cached", "removed")}


def current(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The chunks of the files as the last :func:`refresh`, or that of a version, found them."""
    versions = Versions(spark, target)
    number, state = versions.newest() if version is None else (version, versions.read(version))
    if not number:
        raise ValueError(f"{target} has no version yet")
    named = spark.read.parquet(f"{target}/manifest/{state['load']}").select(F.col("key").alias("path"), "load")
    return spark.read.option("basePath", f"{target}/chunks").parquet(f"{target}/chunks").join(named, ["path", "load"]).drop("load")


def follow(index: SegmentIndex, target: str, chunk_id: Callable[[], Column]) -> SegmentIndex:
    """Bring an index up to the newest :func:`refresh`: chunks of changed and deleted files go, new ones come, in one version.

    The index remembers the refresh that it has followed, so that a call that is repeated changes nothing. ``chunk_id`` makes
    an id of a chunk's columns; only chunks of files that have changed since are read.
    """
    spark, versions = index.spark, Versions(index.spark, target)
    newest, _ = versions.newest()
    since = index.state.get("refresh", 0)
    if since >= newest:
        return index
    loads = [versions.read(n)["load"] for n in range(since + 1, newest + 1)]
    changed = spark.read.schema("path string, action string").parquet(*[f"{target}/changes/{x}" for x in loads]).select("path").distinct()
    of = lambda number: current(spark, target, number).join(changed, "path", "left_semi").select(chunk_id().alias("doc_id"), "text")
    return index.apply(added=of(newest), deleted=of(since).select("doc_id") if since else None, refresh=newest)


EVENTS = "conv_id long, turn long, seq int, event string, data string"


def event_rows(answers: DataFrame) -> DataFrame:
    """The events of streamed answers, a row each: meta, citations, tokens, a replacement where guarding changed it, done.

    ``answers``: conv_id, turn, said (what the model said), final (what guarding left of it), citations (array<string>).
    """
    kind = lambda name, data: F.struct(F.lit(name).alias("event"), data.cast("string").alias("data"))
    tokens = F.regexp_extract_all(F.col("said"), F.lit(r"\S+\s*|\s+"), F.lit(0))
    replaced = F.when(~F.col("said").eqNullSafe(F.col("final")), F.array(kind("replace", F.col("final"))))
    events = F.concat(
        F.array(kind("meta", F.size("citations"))), F.transform("citations", lambda c: kind("citation", c)), F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: kind("token", t)),
        F.coalesce(replaced, F.array().cast("array<struct<event:string,data:string>>")), F.array(kind("done", F.col("final"))),
    )
    return answers.select("conv_id", "turn", F.posexplode(events).alias("seq", "e")).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "seq", "e.event", "e.data")


def send_events(answers: DataFrame, path: str, checkpoint: str):
    """Start writing the events of a stream of answers to the log below ``path``; see :class:`hanji.sources.connectors.EventLog`."""
    connectors.register(answers.sparkSession)
    return event_rows(answers).writeStream.format("event_log").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, text): what each answer ended with, to be kept with the conversation."""
    return events.filter("event = 'done'").select("conv_id", "turn", F.col("data").alias("text"))


def answer_events(answer_tokens: list[str], citations: list[dict], final: str) -> list[dict]:
    """The events of a streamed answer in order: meta, citations, tokens, a replacement where guarding changed it, done."""
    events = [{"event": "meta", "data": {"citations": len(citations)}}]
    events += [{"event": "citation", "data": c} for c in citations]
    events += [{"event": "token", "data": t} for t in answer_tokens]
    if final != "".join(answer_tokens):
        events.append({"event": "replace", "data": final})
    events.append({"event": "done", "data": {"answer": final}})
    return [{"seq": i, **e} for i, e in enumerate(events)]
