"""Spark's Python data source API: members of stored ZIP archives, changes of a refreshed folder, a log of events.

``register(spark)`` makes them known; then ``spark.read.format("zip_members").load(folder)``,
``spark.readStream.format("file_changes").load(target)`` and ``writeStream.format("event_log")``. Folders must be in a store
that Arrow opens.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from struct import unpack

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as stores
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hanji.sources.files import MEMBERS, zip_members

#: Members that a task reads; events that a task holds before it writes them.
RANGE, EVENTS = 64, 10_000
#: Archives from which on small ones share tasks; bytes of an archive that is small, and of those that a task reads.
MANY, WHOLE, PACKED = 64, 1 << 20, 2 << 20


def _listed(folder: str, pattern: str) -> list[tuple[str, int]]:
    """(URI, size) of the files below a folder whose names match."""
    store, base = stores.FileSystem.from_uri(folder)
    scheme = re.match(r"[a-z0-9]+://[^/]*", folder)
    found = store.get_file_info(stores.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted(((scheme[0] if scheme else "") + f.path, f.size) for f in found if f.is_file and re.search(pattern, f.path))


def _open(uri: str):
    store, place = stores.FileSystem.from_uri(uri)
    return store.open_input_file(place)


class _File(io.RawIOBase):
    """An Arrow file as Python's own behave: places before the beginning are an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except ValueError as fault:
            raise OSError(str(fault)) from None

    def readinto(self, buffer: memoryview) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


@dataclass
class MemberRange:
    archive: str
    first: int
    last: int


@dataclass
class MemberRanges(InputPartition):
    ranges: list[MemberRange]


class ZipMembers(DataSource):
    """Rows of :data:`hanji.sources.files.MEMBERS` of all ``.zip`` files below a folder, a partition every 64 members of
    an archive. Of more than 64 archives those up to 1 MB are read whole, as many in a partition as make 2 MB.

    The driver reads the last bytes of the archives that are read by ranges, which count their members. Filters on ``archive`` drop partitions,
    filters on ``member`` drop members before they are unpacked.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(self.options["path"])


class ZipReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.filters = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("archive",), ("member",)):
                self.filters.append(f)
            else:
                yield f

    def _passes(self, column: str, value: str | None) -> bool:
        mine = [f for f in self.filters if f.attribute == (column,)]
        if value is None:
            return not mine
        ok = {EqualTo: lambda f: value == f.value, In: lambda f: value in f.value, StringStartsWith: lambda f: value.startswith(f.value), StringEndsWith: lambda f: value.endswith(f.value)}
        return all(ok[type(f)](f) for f in mine)

    @staticmethod
    def members(uri: str, size: int) -> int:
        """How many members the archive's closing record counts; 1 where it has none, for the row that tells so."""
        with _open(uri) as file:
            tail = file.read_at(min(size, 65_557), max(0, size - 65_557))
        at = tail.rfind(b"PK\x05\x06")
        return max(1, unpack("<H", tail[at + 10 : at + 12])[0]) if 0 <= at <= len(tail) - 22 else 1

    def partitions(self) -> list[InputPartition]:
        out, whole, held = [], [], 0
        archives = [(uri, size) for uri, size in _listed(self.folder, r"(?i)\.zip$") if self._passes("archive", uri)]
        for uri, size in archives:
            if len(archives) > MANY and size <= WHOLE:
                if whole and held + size > PACKED:
                    out.append(MemberRanges(whole))
                    whole, held = [], 0
                whole.append(MemberRange(uri, 0, 1 << 31))
                held += size
                continue
            n = self.members(uri, size)
            # A record that counts 65,535 means that there are as many or more: the last range is open.
            out += [MemberRanges([MemberRange(uri, a, a + RANGE if a + RANGE < n else 1 << 31)]) for a in range(0, n, RANGE)]
        return [*out, MemberRanges(whole)] if whole or not out else out

    def read(self, partition: MemberRanges) -> Iterator[tuple]:
        wanted = (lambda m: self._passes("member", m)) if any(f.attribute == ("member",) for f in self.filters) else None
        for some in partition.ranges:
            with _open(some.archive) as file:
                yield from zip_members(some.archive, io.BufferedReader(_File(file)), some.first, some.last, wanted=wanted)


@dataclass
class ChangeFile(InputPartition):
    uri: str
    version: int


class FileChanges(DataSource):
    """A stream of (path, action, version) of what each refresh of a folder processed and removed, deletions included.

    Offsets are version numbers, so a batch holds whole versions, and what a broken-off refresh left is never seen.
    ``from_version`` begins after that version.
    """

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, action string, version int"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangeReader(self.options["path"].rstrip("/"), int(self.options.get("from_version", 0)))


class ChangeReader(DataSourceStreamReader):
    def __init__(self, target: str, first: int):
        self.target, self.first = target, first

    def initialOffset(self) -> dict:
        return {"version": self.first}

    def latestOffset(self) -> dict:
        numbers = [int(re.search(r"v(\d+)\.json$", uri)[1]) for uri, _ in _listed(f"{self.target}/versions", r"/v\d+\.json$")]
        return {"version": max([self.first, *numbers])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for version in range(start["version"] + 1, end["version"] + 1):
            with _open(f"{self.target}/versions/v{version}.json") as file:
                load = json.loads(file.read())["load"]
            out += [ChangeFile(uri, version) for uri, _ in _listed(f"{self.target}/changes/{load}", r"\.parquet$")]
        return out or [ChangeFile("", 0)]

    def read(self, partition: ChangeFile) -> Iterator[pa.RecordBatch]:
        if partition.uri:
            with _open(partition.uri) as file:
                table = pq.read_table(file, columns=["path", "action"])
            yield from table.append_column("version", pa.array([partition.version] * table.num_rows, pa.int32())).to_batches()


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class EventLog(DataSource):
    """A sink that has every event of a stream once, whatever is killed and run again.

    Tasks write files under names of their own and report them; when a batch is whole, one small file that bears its number
    names them. A batch that is run again after that finds it and drops what it wrote; one that breaks off before
    leaves files that nothing names. :func:`events` reads what is named.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return EventWriter(self.options["path"].rstrip("/"), schema)


class EventWriter(DataSourceStreamWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = stores.FileSystem.from_uri(f"{self.path}/data")
        arrow, out, rows, name = to_arrow_schema(self.schema), None, 0, f"{uuid.uuid4().hex}.parquet"
        while some := list(islice(iterator, EVENTS)):
            if out is None:
                store.create_dir(base, recursive=True)
                out = pq.ParquetWriter(f"{base}/{name}", arrow, filesystem=store)
            out.write_table(pa.Table.from_pylist([r.asDict(recursive=True) for r in some], schema=arrow))
            rows += len(some)
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, base = stores.FileSystem.from_uri(f"{self.path}/batches")
        place = f"{base}/{batchId}.json"
        if store.get_file_info(place).type != stores.FileType.NotFound:
            self.abort(messages, batchId)
            return
        store.create_dir(base, recursive=True)
        draft = f"{base}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as file:
            file.write(json.dumps([m.file for m in messages if m and m.file]).encode())
        store.move(draft, place)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, base = stores.FileSystem.from_uri(f"{self.path}/data")
        for m in messages:
            if m and m.file:
                store.delete_file(f"{base}/{m.file}")


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of all whole batches below a path that ``event_log`` wrote to."""
    named = []
    for uri, _ in _listed(f"{path}/batches", r"/\d+\.json$"):
        with _open(uri) as file:
            named += json.loads(file.read())
    rows = spark.read.schema(schema)
    return rows.parquet(*[f"{path}/data/{n}" for n in named]) if named else spark.createDataFrame([], schema)


def register(spark: SparkSession) -> None:
    """Make the sources and sinks known to a session, and have filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZipMembers, FileChanges, EventLog):
        spark.dataSource.register(source)
