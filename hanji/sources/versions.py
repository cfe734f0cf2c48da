"""Versions of a stored data set: which of its immutable folders count, switched by one rename.

A writer puts its folders beside those that are there, under names of its own, and then commits a version that names them.
Readers see the newest version whole or not at all. A commit says which version it builds on and fails with
:class:`Conflict` where another has been committed since, so that racing writers cannot undo one another's work.
What broken-off writers leave is named by no version and never read; :meth:`Versions.sweep` removes it.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit builds on."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Without either, a local session gets a temporary folder; a cluster is refused, as its executors could not see one.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = shared_folder.own = getattr(shared_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="hanji-")
    return base.rstrip("/")


def own_folder(spark: SparkSession, name: str = "query") -> str:
    """A new folder in the shared one, which goes when the JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(rows: DataFrame, name: str = "table") -> DataFrame:
    """``rows`` written once to the shared folder and read back: its size is known then, and no plan computes it again."""
    path = own_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def newest(self) -> tuple[int, dict]:
        """(number, state); (0, {}) where nothing has been committed."""
        number = max((int(m[1]) for n in self._names("versions") if (m := re.fullmatch(r"v(\d+)\.json", n))), default=0)
        return number, self.read(number) if number else {}

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"versions/v{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, state: dict) -> int:
        """Make ``state`` the version after ``after``."""
        number = after + 1
        draft, final = self._path(f"versions/.draft-{uuid.uuid4().hex}"), self._path(f"versions/v{number}.json")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(state, sort_keys=True).encode())
        stream.close()
        keep = getattr(self._hadoop, "Options$Rename").NONE
        options = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = keep
        try:
            if number != self.newest()[0] + 1:
                raise Conflict(f"version {number} has been committed by another writer")
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, final, options)
        except Conflict:
            self._fs.delete(draft, False)
            raise
        except Exception as fault:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(fault):
                raise Conflict(f"version {number} has been committed by another writer") from None
            raise
        return number

    def sweep(self, folder: str, named: set[str], *, keep: set[str] = frozenset()) -> list[str]:
        """Delete what lies in ``folder`` and is neither in ``named`` nor in ``keep``; the names that went."""
        gone = [n for n in self._names(folder) if n not in named and n not in keep]
        for n in gone:
            self._fs.delete(self._path(f"{folder}/{n}"), True)
        return gone
