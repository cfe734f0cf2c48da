"""Keyed state in event time: whatever the batches, decisions equal a fold over the events in order."""

import random

import pytest
from pyspark.sql import functions as F

from hanji.operators import limits
from hanji.sources.versions import own_folder
from hanji.streaming import keyed

START = 1_700_000_040


def folded(rows, step, new):
    out, states = [], {}
    for k, t in sorted(rows):
        states[k], taken = step(states.get(k, new), float(t))
        out.append((k, t, taken))
    return sorted(out)


def decided(rows):
    return [r for r in rows if r[0] != "end"]


def stream(spark, batches, make, name):
    """Run ``make`` over batches that arrive as files, one at a time."""
    base = own_folder(spark, name)
    out = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        with keyed.rocksdb(spark):
            read = spark.readStream.schema("k string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
            make(read).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out").select("key", F.col("at").cast("long").alias("t"), "taken")
    return base, sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def batches():
    """Out of order within two minutes; a last event closes all slots before it."""
    rng = random.Random(6)
    times = sorted(START + rng.randrange(3000) for _ in range(500))
    rows = [(f"k{rng.randrange(4)}", t) for t in times]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(100))
    return [late[:150], late[150:400], late[400:], [("end", START + 9000)], [("end", START + 9999)]]


def test_limiter_equals_a_fold(spark, batches):
    rows = [r for b in batches[:-2] for r in b]
    _, got = stream(spark, batches, lambda df: keyed.limiter(df, key="k", at="at", limit=5, seconds=300, lateness="2 minutes"), "limiter")
    assert decided(got) == folded(rows, limits.sliding_log(5, 300), [])


def test_history_equals_a_fold(spark, batches):
    rows = [r for b in batches[:-2] for r in b]
    _, got = stream(spark, batches, lambda df: keyed.history(df, query="k", at="at", lateness="2 minutes"), "history")
    assert decided(got) == folded(rows, limits.spaced(300), None)


def test_cache_equals_a_fold_and_state_goes(spark, batches):
    rows = [r for b in batches[:-2] for r in b]
    base, got = stream(spark, batches, lambda df: keyed.cached(df, key="k", at="at", ttl=60.0, lateness="2 minutes"), "cache")
    assert decided(got) == folded(rows, keyed.cache_step(60.0), [])
    with keyed.rocksdb(spark):
        left = spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "log").load()
        assert left.filter("key.key <> 'end'").count() == 0  # entries' lives have passed, so timers have dropped them


def test_limiter_begins_with_what_was_accepted_before(spark):
    before = spark.createDataFrame([("a", START - 10), ("a", START - 5), ("b", START - 1000)], "key string, s long").select("key", F.timestamp_seconds("s").alias("at"))
    rows = [("a", START + i) for i in range(4)] + [("b", START + i) for i in range(4)]
    _, got = stream(spark, [rows, [("end", START + 9000)]], lambda df: keyed.limiter(df, key="k", at="at", limit=3, seconds=60, accepted=before), "initial")
    assert [taken for k, _, taken in got if k == "a"] == [True, False, False, False]
    assert [taken for k, _, taken in got if k == "b"] == [True, True, True, False]


def test_fold_of_a_hot_key_holds_a_batch_at_a_time(spark):
    events = spark.range(300_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(START) + F.col("id") % 86_400).alias("at"))
    row = limits.rate_limited(events, key="k", at="at", limit=7, seconds=60).first()
    assert row["allowed"] + row["blocked"] == 300_000 and row["allowed"] == 86_400 // 60 * 7


def test_a_key_costs_a_timer_a_batch_however_many_slots_it_has(spark):
    base = own_folder(spark, "slots")
    spark.range(1000).select((F.col("id") % 2).cast("string").alias("k"), F.timestamp_seconds(START + 60 * F.col("id")).alias("at")).coalesce(1).write.parquet(f"{base}/in")
    with keyed.rocksdb(spark):
        decided = keyed.limiter(spark.readStream.schema("k string, at timestamp").parquet(f"{base}/in"), key="k", at="at", limit=2, seconds=600)
        run = decided.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    timers = [o["customMetrics"].get("numRegisteredTimers", 0) for p in run.recentProgress for o in p["stateOperators"]]
    assert 0 < sum(timers) <= 2 * len(run.recentProgress)
    assert spark.read.parquet(f"{base}/out").count() == 998  # the last minute is the watermark's, and its slot and the one before stay open
