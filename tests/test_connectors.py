"""Python data sources and sinks: archives by member ranges, pushed filters, and an event log under replay."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from hanji.sources import connectors, files
from hanji.streaming import jobs


def test_archives_are_read_by_ranges_as_whole_ones_are(spark, tmp_path):
    connectors.register(spark)
    for name, n in (("a.zip", 200), ("sub/b.ZIP", 3), ("c.zip", 0)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(n):
                z.writestr(("same.txt", f"d/{i}.txt", "../up.txt", f"{i}.exe")[i % 4], f"text {i}")
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(out.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "other.txt").write_text("x")
    got = spark.read.format("zip_members").load(f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() == 4 + 1 + 1 + 1
    rows = sorted((r["archive"].rsplit("/", 1)[1], r["member"] or "", r["name"] or "", r["status"], bytes(r["content"] or b"")) for r in got.collect())
    whole = [(p, (tmp_path / p).read_bytes()) for p in ("a.zip", "sub/b.ZIP", "c.zip", "broken.zip")]
    want = [(p.rsplit("/", 1)[-1], m or "", n or "", s, d or b"") for p, raw in whole for _, m, n, s, _, d in files.zip_members(p, io.BytesIO(raw))]
    assert rows == sorted(want) and len(rows) == 200 + 3 + 1
    one = got.filter((F.col("member") == "d/5.txt") & F.col("archive").endswith("a.zip"))
    assert [bytes(r["content"]) for r in one.collect()] == [b"text 5"]
    assert "member" not in str(one._jdf.queryExecution().executedPlan()).split("Filter")[-1].split("BatchScan")[0] or one.count() == 1


def test_a_replayed_batch_leaves_each_event_once(spark, tmp_path):
    schema = "conv_id long, turn long, said string, final string, citations array<string>"
    base = f"file://{tmp_path}"
    made = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    send = lambda: jobs.send_events(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/log", f"{base}/state").awaitTermination()
    made([(1, 1, "two words", "two words", ["a"]), (2, 3, "made up", "refused", []), (3, 1, None, "none", [])])
    send()
    first = sorted(tuple(r) for r in connectors.events(spark, f"{base}/log", jobs.EVENTS).collect())
    assert [r[2:] for r in first if r[0] == 2] == [(0, "meta", "0"), (1, "token", "made "), (2, "token", "up"), (3, "replace", "refused"), (4, "done", "refused")]
    # As after a crash between the sink's commit and the stream's own.
    for f in (tmp_path / "state" / "commits").iterdir():
        f.unlink()
    send()
    assert sorted(tuple(r) for r in connectors.events(spark, f"{base}/log", jobs.EVENTS).collect()) == first
    named = [n for f in (tmp_path / "log" / "batches").glob("[0-9]*.json") for n in json.loads(f.read_text())]
    assert sorted(named) == sorted(p.name for p in (tmp_path / "log" / "data").glob("*.parquet"))
    # As after a crash while a batch was written: its file is named nowhere.
    (tmp_path / "log" / "data" / "lost.parquet").write_bytes(b"half a file")
    made([(4, 1, "later", "later", [])])
    send()
    after = connectors.events(spark, f"{base}/log", jobs.EVENTS)
    assert after.count() == len(first) + 3
    assert {(r["conv_id"], r["text"]) for r in jobs.last_messages(after).collect()} == {(1, "two words"), (2, "refused"), (3, "none"), (4, "later")}
