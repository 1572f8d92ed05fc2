"""Cutting lineage: a DataFrame written to the shared folder and read back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own if driver and executors are one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="folioflow-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` under the shared folder and reads it back.

    What several later steps read is then computed once, and a lost executor
    doesn't bring the steps before it back. The table goes with ``drop``, or
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, p = _files(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a cut table that nothing reads any more."""
    if path := getattr(df, "_folio_path", None):
        files, p = _files(df.sparkSession, path)
        files.delete(p, True)
