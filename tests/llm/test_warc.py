"""WARC: round trips, revisits, and what is salvaged from damaged archives."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hanji.llm import warc
from hanji.llm.common import settle

DATE = "2020-01-01T00:00:00Z"


def plain(page_id, payload, refers_to=None, url="http://a.example/x y"):
    return warc.record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to, DATE)


def scanned(data):
    return list(warc.scan(warc.Bytes(data)))


def records(found):
    return [what[1] for *_, what, _ in found if what]


def gaps(found):
    return [(a, b) for a, b, why, what, _ in found if not what]


def test_records_come_back_plain_packed_and_mixed():
    bodies = [b"", b"x" * 300, b"WARC/1.1\r\nin a payload\r\n\r\n", bytes(range(256)) * 9]
    made = [plain(i, b) for i, b in enumerate(bodies)]
    for data in (b"".join(made), b"".join(gzip.compress(r) for r in made), made[0] + gzip.compress(made[1]) + made[2] + gzip.compress(made[3]), gzip.compress(b"".join(made))):
        found = scanned(data)
        assert records(found) == [0, 1, 2, 3] and not gaps(found)
        assert [payload for *_, payload in found] == bodies
        assert [what[5] for *_, what, _ in found] == [len(b) for b in bodies]
    what = scanned(plain(7, b"y" * 500, refers_to=3))[0][3]
    assert what == ("revisit", 7, "http://a.example/x%20y", 3, hashlib.sha256(b"y" * 500).hexdigest(), 500)
    assert scanned(b"") == []


@pytest.mark.parametrize("packed", [True, False])
def test_a_flipped_byte_costs_one_record_at_most(packed):
    """Whatever byte is flipped, all other records come back, and gaps cover the damaged record alone."""
    rng = random.Random(5)
    made = [plain(i, rng.randbytes(rng.randrange(400)) + b"text " * rng.randrange(90)) for i in range(6)]
    stored = [gzip.compress(r) if packed else r for r in made]
    ends = [sum(map(len, stored[: i + 1])) for i in range(6)]
    data = b"".join(stored)
    for place in range(0, len(data), 3):
        hurt = data[:place] + bytes([data[place] ^ 0x55]) + data[place + 1 :]
        owner = next(i for i, e in enumerate(ends) if place < e)
        found = scanned(hurt)
        assert set(range(6)) - {owner} <= set(records(found))
        for a, b in gaps(found):
            assert ends[owner] - len(stored[owner]) <= a < b <= ends[owner]


def test_gaps_tell_place_and_reason():
    made = [gzip.compress(plain(i, b"p%d " % i * 90)) for i in range(5)]
    junk = b"\x1f\x8b\x08 no member \x00" * 40 + b"WARC/1.0\r\nno record"
    cut = made[3][: len(made[3]) // 2]
    data = made[0] + junk + made[1] + made[2] + cut + made[4] + made[0][:9]
    found = scanned(data)
    assert records(found) == [0, 1, 2, 4]
    n = [len(m) for m in made]
    assert gaps(found) == [(n[0], n[0] + len(junk)), (at := n[0] + len(junk) + n[1] + n[2], at + len(cut)), (len(data) - 9, len(data))]
    assert all(why for _, _, why, what, _ in found if not what)


def test_whole_records_before_damage_in_a_long_member_are_recovered():
    rng = random.Random(8)
    made = [plain(i, rng.randbytes(60_000)) for i in range(8)]
    data = gzip.compress(b"".join(made))
    hurt = bytearray(data)
    hurt[len(data) * 5 // 8 : len(data) * 5 // 8 + 9] = b"\0" * 9
    found = scanned(bytes(hurt) + gzip.compress(made[0]))
    assert records(found)[:4] == [0, 1, 2, 3] and records(found)[-1] == 0
    assert gaps(found) == [(0, len(data))]


def test_other_writers_headers():
    body = b"HTTP/1.0 404 Not Found\r\nServer: x\r\n\r\nGone"
    sha1 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"Gone").digest()).decode()
    head = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Long: a\r\n  b\r\nWARC-Payload-Digest: {sha1}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
    found = scanned(info + head + body + b"\r\n\r\n" + head + body.replace(b"Gone", b"Gome") + b"\r\n\r\n" + info)
    assert [w and w[0] for *_, w, _ in found] == ["warcinfo", "response", None, "warcinfo"]
    assert found[2][2] == "payload differs from its digest"


def model(rows):
    """One row a page, from the definition."""
    body = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in body:
        ids = [j for j, c in body if c == b and j is not None]
        first = min(ids) if len(b) >= 100 and sum(c == b for _, c in body) > 1 and ids else None
        to = None if first is None or first == i else first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_pages_through_archives_equal_brute_force(spark, tmp_path):
    same, long = "<p>" + "same " * 30, "<p>" + "löng ☃ " * 300_000
    rows = [(5, "http://a/1", same), (3, None, same), (9, "u\r\nv: w", same), (9, "u", same), (1, "", "short"), (2, "x", "short"), (None, "n", same), (None, None, None), (4, "e", ""), (6, "l", long), (7, "l", long), (8, "q", "z" * 100), (8, "q", "z" * 100), (10, "q", "z" * 99), (11, "q", "z" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "payload", "first", "n", "path", "type", "refers_to")})
    for compress, size in ((True, 300), (False, 1 << 20)):
        manifest = settle(warc.write(warc.decide(pages.repartition(3)), f"file://{tmp_path}/{compress}", archive_bytes=size, compress=compress))
        got = warc.read(warc.spread(manifest), payload=True).collect()
        assert sorted([(r["page_id"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"]) for r in got], key=str) == model(rows)
        assert not [r for r in got if r["reason"]]
        assert {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["payload"] is not None and r["page_id"] in (3, 6, 1)} == {3: same, 6: long, 1: "short"}
        assert sum(r["records"] for r in manifest.collect()) == len(rows)
        assert "u%0D%0Av:%20w" in {r["url"] for r in got}
    assert warc.read(settle(warc.write(warc.decide(pages.limit(0)), f"file://{tmp_path}/none"))).count() == 0


def test_damaged_archives_on_spark(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat_ws(" ", F.lit("page"), F.col("id"), F.expr("repeat(cast(id as string), 60)")).alias("html"))
    manifest = settle(warc.write(warc.decide(pages.coalesce(2)), f"file://{tmp_path}/a", archive_bytes=9_000))
    whole = {r["page_id"]: r for r in warc.read(manifest).collect()}
    lost = set()
    for r in list(whole.values())[::37]:
        with open(r["path"].removeprefix("file://"), "r+b") as f:
            f.seek((r["start"] + r["stop"]) // 2)
            f.write(b"\xff\x00damage")
        lost.add((r["path"], r["start"], r["stop"]))
    got = warc.read(warc.spread(manifest)).collect()
    assert {r["page_id"] for r in got if r["type"]} == {i for i, r in whole.items() if (r["path"], r["start"], r["stop"]) not in lost}
    assert {(r["path"], r["start"], r["stop"]) for r in got if r["reason"]} == lost
