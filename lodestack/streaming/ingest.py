"""Continuous ingest of a landing folder.

Each micro-batch is converted and written under its batch number, so a replayed batch overwrites itself; children are
settled before parents are called done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import process

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream of root files."""
    raw = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    none = lambda kind: F.lit(None).cast(kind)
    return raw.select(F.col("path").alias("id"), none("string").alias("root_id"), none("string").alias("parent_id"), F.lit(0).alias("index_in_parent"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit("application/octet-stream").alias("content_type"), "content", F.lit("{}").alias("metadata_json"))


def ingest_stream(files: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Process the stream into ``out``/batch=<n>; ``every`` is a processing-time trigger, None takes what is there and stops."""

    def batch(df: DataFrame, number: int) -> None:
        process(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def finished_trees(processed: DataFrame) -> DataFrame:
    """Roots all of whose files are there and converted: id, n_files, n_documents, n_errors."""
    rows = processed.withColumn("root", F.coalesce("root_id", "id"))
    sums = rows.groupBy("root").agg(F.count("*").alias("n_files"), F.sum(F.col("n_children")).alias("children"), F.sum(F.col("is_document").cast("int")).alias("n_documents"), F.sum(F.col("error").isNotNull().cast("int")).alias("n_errors"))
    return sums.filter("n_files = children + 1").select(F.col("root").alias("id"), "n_files", "n_documents", "n_errors")


def rolling_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by time window and key with a watermark: an extension for event tables, not part of document ingest."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
