"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside this class (blank, and U+0009 to U+000D).
BLANKS = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\f\r"

_OWN_DIR: str | None = None


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for tables that cut lineage.

    It is the one named by ``spark.checkpoint.dir``. Only where that is unset
    (tests in one process) a temporary folder is made, and removed at exit.
    """
    global _OWN_DIR
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="folioflow-")
        atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
    return f"file://{_OWN_DIR}"


#: Bytes of one Arrow batch, beyond which no row is added.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session by bytes as well as rows (10,000 long texts are no small batch)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Workspace:
    """Tables written for one run of an operator, in a folder of their own.

    A written table cuts lineage, so that a lost executor never forces the
    stages before it to run again, and never changes what later stages see.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def read(self, path: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _files(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def exists(self, path: str) -> bool:
        files, p = self._files(path)
        return files.exists(p)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read from the files."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.read(path, df.schema)
        out._folio_path = path  # for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a saved table that no later step reads."""
        path = getattr(df, "_folio_path", None)
        if path:
            files, p = self._files(path)
            files.delete(p, True)


def crc_of_id(col: Column | str) -> Column:
    """Unsigned crc32 of an id written as decimal text; null for a null id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary"))


def held_out(col: Column | str, parts: int, part: int) -> Column:
    """True for ids whose crc32 leaves ``part`` modulo ``parts``; false for a null id."""
    return F.coalesce(crc_of_id(col) % F.lit(parts) == F.lit(part), F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows: those with the smallest hash of ``keys``, the same on every run.

    Rows are first thinned by their hash to little more than ``most`` in all, so
    that the sort's end doesn't take ``most`` rows from every task.
    """
    n = df.count()
    drawn = df.withColumn("_h", F.pmod(F.xxhash64(*keys), F.lit(1 << 30)))
    if n > most:
        drawn = drawn.where(F.col("_h") < int((1.1 * most + 100) / n * (1 << 30)))
    return drawn.orderBy("_h", *keys).limit(most).drop("_h")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def each_text(column, rows: int = 256):
    """A column's values in turn, few of them as Python objects at a time."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).to_pylist()


def frugal(run):
    """For a function over Arrow batches: gives memory back when a task ends.

    Python workers live on for later tasks and stages; what their allocators
    keep would otherwise add up beside the heap of an executor.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
