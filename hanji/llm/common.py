"""Helpers shared by the corpus-preparation operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space. ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def word_array(column: Column | str) -> Column:
    """All words of a text, in order; null counts as empty."""
    return F.regexp_extract_all(text_or_empty(column), F.lit(WORD), F.lit(0))


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32(id as text) leaves ``remainder``; a null id is never held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder (tests); a cluster is refused one, because its
    executors could not read it.
    """
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    known = getattr(shared_dir, "own", None)
    if known is None:
        known = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="hanji-")
    return known


def settle(df: DataFrame, *, files: int | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the JVM ends. Parquet rather than ``checkpoint()`` so that later steps prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hanji-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    (df.coalesce(files) if files else df).write.parquet(path, compression=compression)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a Python worker gets at once, about. Texts are held several times over on the way, in the JVM and in the
#: worker, so the usual 64 MB would take hundreds of MB a task.
BATCH_BYTES = 2_000_000


def text_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes to suit texts and media, unless the session has set a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give memory that a worker no longer uses back to the system: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def keep(df: DataFrame) -> DataFrame:
    """:func:`settle` for tables that are small against the texts: an eighth as many tasks and files as shuffles have.

    Chained caching would leave plans nested in plans; many small files would cost a file system call or two each.
    """
    return settle(df, files=max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
