"""Documents as they arrive: a file stream through the same parsing as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources import documents


def stream_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(doc_key, raw) of each new file; ``max_files`` bounds a micro-batch."""
    lines = spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", max_files).text(folder)
    return lines.select(F.input_file_name().alias("doc_key"), F.col("value").alias("raw"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Writes parsed documents under ``out``; each file once, as the checkpoint remembers. Returns the query."""
    parsed = documents.parse(stream_files(spark, folder))
    return parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
