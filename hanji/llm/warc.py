"""WARC archives with revisit records, and a reader that salvages damaged ones (operator 13).

:func:`write` turns rows into WARC 1.1 records, each a gzip member of its own or plain, in archives of bounded size. A task
names its archives at random and returns their names, so that the manifest, which Spark commits, lists those of the
attempt that counted; what lost or repeated attempts left behind is never read. Records with equal payloads of at least
:data:`REVISIT_BYTES` become revisits of the one with the smallest id: ids meet on payload digests alone, so payloads are
shuffled only where the table of repeated digests is too large to broadcast.

:func:`read` goes through each archive once. A record must have a version line, headers, as many bytes as they declare, the
closing blank lines, the payload digest that it states and, in a gzip member, the member's checksum. Where a check fails,
the reader searches byte by byte for the next gzip member that opens with a version line, or the next version line, from
which a whole record can be read, goes on there, and logs the bytes between as a gap with the failed check. Of a member
that breaks off or is damaged inside, whole records before the damage are recovered where their digest proves them.
An archive is read through a window, so a task holds one record and not the archive.

Defined cases: a null payload is empty; null ids write ``urn:page:`` without number and are read as null; a null id never
is the one that others refer to; rows that share the smallest id of a payload are all responses, since a record does not
revisit itself; null URLs write no target, and control characters, spaces and percent signs in URLs are percent-encoded;
very long payloads are one record each; an empty table writes no archive; extra columns, whatever their names, are ignored.
An archive that is empty has neither records nor gaps. A damaged record that holds a complete record inside its payload
(a page about WARC, stored plain) gives up that inner one. Folders must be in a store that Arrow opens (local, HDFS, S3 ...).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanji.llm.common import keep, read as table, release, settle, shared_dir, text_batches

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 100
#: An archive ends with the record that reaches this size.
ARCHIVE_BYTES = 128 << 20
#: Bytes that are read at once; bytes of payload that a batch of rows holds, about; rows of a batch.
BLOCK, BATCH, ROWS = 1 << 20, 2 << 20, 2000
LEVEL = 1
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "path string, start long, stop long, reason string, type string, page_id long, url string, refers_to long, digest string, payload_bytes long"
MANIFEST = "path string, bytes long, records long"


# Writing


def decide(pages: DataFrame, *, payload: str = "html", key: str = "page_id", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of all rows; ``refers_to`` is null for records that are responses."""
    content = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), content.alias("payload"), F.unhex(F.sha2(content, 256)).alias("digest"))
    large = rows.filter(F.length("payload") >= least)
    repeated = keep(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", first.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. A revisit has the response's headers without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub('[\x00-\x20%\x7f]', lambda m: quote(m[0], safe=''), url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, compress: bool = True, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(path, bytes, records) of the archives that the rows of :func:`decide` were written to. Evaluate it once: each evaluation writes."""
    text_batches(records.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stores.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0
        done = lambda: pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")], strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, payload, digest.hex(), refers_to, date)
                if compress:
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()
        release()

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(work, MANIFEST)


# Reading


class Damage(Exception):
    """A failed check; ``found`` is what a broken member gave before it."""

    def __init__(self, reason: str, found: bytes = b""):
        super().__init__(reason)
        self.found = found


class Window:
    """Bytes of an open file by place, a block or two in memory."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def get(self, start: int, count: int) -> bytes:
        """Up to ``count`` bytes from ``start``."""
        if not (self.at <= start and start + count <= self.at + len(self.held)):
            self.at, self.held = start, self.file.read_at(min(max(count, BLOCK), max(0, self.size - start)), start)
        return self.held[start - self.at : start - self.at + count]

    def find(self, pattern: re.Pattern[bytes], start: int) -> int | None:
        while start < self.size:
            part = self.get(start, BLOCK)
            if m := pattern.search(part):
                return start + m.start()
            start += max(1, len(part) - 8)
        return None


class Bytes(Window):
    def __init__(self, data: bytes):
        self.size, self.data = len(data), data

    def get(self, start: int, count: int) -> bytes:
        return self.data[start : start + count]


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
OPENING = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: The longest header block that is looked for, so that damage does not make the reader take the rest of a file for one.
HEADER_BYTES = 1 << 20


def fields(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; of repeated ones the last; a line that begins with white space continues."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", block).split(b"\r\n")
    return {name.strip().lower().decode("utf-8", "replace"): value.strip().decode("utf-8", "replace") for name, colon, value in (line.partition(b":") for line in lines) if colon}


def digest_of(named: str, payload: bytes) -> bool:
    """Whether a payload has the digest that is stated, in hex or base 32; one of an unknown kind proves nothing wrong."""
    kind, _, value = named.partition(":")
    if kind.lower() not in ("sha256", "sha1", "md5"):
        return True
    digest = hashlib.new(kind.lower(), payload).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def number(urn: str) -> int | None:
    m = re.fullmatch(rf"<?{URN}(-?\d+)>?", urn)
    return int(m[1]) if m else None


def parse(data: Window, start: int, *, proven: bool = False) -> tuple[tuple, bytes, int]:
    """(type, page_id, url, refers_to, digest, payload_bytes), the payload and the place after the record at ``start``."""
    head = data.get(start, min(HEADER_BYTES, 4096))
    end = head.find(b"\r\n\r\n")
    if end < 0:
        head = data.get(start, HEADER_BYTES)
        end = head.find(b"\r\n\r\n")
    version = VERSION.match(head)
    if not version:
        raise Damage("no version line")
    if end < 0:
        raise Damage("headers do not end")
    have = fields(head[version.end() : end])
    length = have.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Damage("no length")
    body, stop = start + end + 4, start + end + 4 + int(length)
    if stop + 4 > data.size:
        raise Damage("record breaks off")
    block = data.get(body, int(length) + 4)
    if block[-4:] != b"\r\n\r\n":
        raise Damage("record is not closed where its length ends")
    block, http = block[:-4], {}
    payload = block
    if have.get("content-type", "").startswith("application/http"):
        above, blank, payload = block.partition(b"\r\n\r\n")
        http = fields(above.partition(b"\r\n")[2]) if blank else {}
    kind, named = have.get("warc-type", ""), have.get("warc-payload-digest", "")
    size = len(payload)
    if kind == "revisit":
        size = int(http["content-length"]) if re.fullmatch("[0-9]{1,18}", http.get("content-length", "")) else None
    elif named and not digest_of(named, payload):
        raise Damage("payload differs from its digest")
    if proven and (kind == "revisit" or not named):
        raise Damage("nothing proves the record")
    value = named.partition(":")[2] or hashlib.sha256(payload).hexdigest()
    return (kind, number(have.get("warc-record-id", "")), have.get("warc-target-uri"), number(have.get("warc-refers-to", "")), value, size), payload, stop + 4


def inflate(data: Window, start: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``start`` and the place after it."""
    unpacker, content, place = zlib.decompressobj(31), bytearray(), start
    try:
        while not unpacker.eof:
            block = data.get(place, 1 << 16)
            if not block:
                raise Damage("member breaks off", bytes(content))
            content += unpacker.decompress(block)
            place += len(block)
            if content[:7] != b"WARC/1."[: len(content)]:
                raise Damage("member holds no record")
    except zlib.error as fault:
        raise Damage(f"member: {str(fault)[:80]}", bytes(content)) from None
    return bytes(content), place - len(unpacker.unused_data)


Found = tuple[int, int, str | None, tuple | None, bytes]


def opened(data: Window, place: int, members: bool, proven: bool) -> tuple[list[Found], int]:
    """What is found in the member or record at ``place``, and the place after it."""
    if not members or data.get(place, 3) != b"\x1f\x8b\x08":
        what, payload, stop = parse(data, place, proven=proven)
        return [(place, stop, None, what, payload)], stop
    content, stop = inflate(data, place)
    inner = list(scan(Bytes(content), members=False))
    if not any(what for *_, what, _ in inner):
        raise Damage(inner[0][2] if inner else "member is empty")
    return [(place, stop, why and f"in the member at {at}: {why}", what, payload) for at, _, why, what, payload in inner], stop


def scan(data: Window, *, members: bool = True, proven: bool = False) -> Iterator[Found]:
    """(start, stop, failed check, fields, payload) of all records and gaps, in order; gaps have no fields, records no check.

    ``proven`` keeps only records that their digest proves. Records before the damage inside a member have the member's
    start for both places, as the member itself belongs to the gap.
    """
    place, damaged, reason = 0, None, ""
    while place < data.size:
        try:
            found, stop = opened(data, place, members, proven)
        except Damage as fault:
            if damaged is None:
                damaged, reason = place, str(fault)
            for _, _, _, what, payload in scan(Bytes(fault.found), members=False, proven=True):
                if what:
                    yield place, place, None, what, payload
            following = data.find(OPENING if members else VERSION, place + 1)
            stop = data.size if following is None else following
        else:
            if damaged is not None:
                yield damaged, place, reason, None, b""
                damaged = None
            yield from found
        place = stop
    if damaged is not None:
        yield damaged, data.size, reason, None, b""


def read(archives: DataFrame, *, payload: bool = False) -> DataFrame:
    """All records and gaps of the archives in column ``path``: gaps have a ``reason``, records a ``type``.

    ``start`` and ``stop`` are places in the archive, of the member where a record is in one. With ``payload``, records
    bring theirs (null for revisits: join ``refers_to``).
    """
    schema = RECORD + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(path: str) -> Iterator[tuple]:
        store, place = stores.FileSystem.from_uri(path)
        with store.open_input_file(place) as file:
            for start, stop, reason, what, content in scan(Window(file)):
                fixed = (path, start, stop, reason, *(what or (None,) * 6))
                yield (*fixed, content if what and what[0] != "revisit" else None) if payload else fixed

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]
        made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
        for batch in batches:
            held, size = [], 0
            for path in batch.column("path").to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or b"") if payload else 0
                    if len(held) >= ROWS or size >= BATCH:
                        yield made(held)
                        held, size = [], 0
            if held:
                yield made(held)
        release()

    return archives.select("path").mapInArrow(work, schema)


def spread(manifest: DataFrame) -> DataFrame:
    """A partition an archive, about: the rows are few and small, but what they name is not."""
    return manifest.repartition(max(1, manifest.count()))


def op13_warc_salvage(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/hanji-warc-{uuid.uuid4().hex}"
    manifest = settle(write(decide(table(spark, sf_dir, "pages")), folder))
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    records = read(spread(manifest)).filter("type IS NOT NULL")
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP13_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""
