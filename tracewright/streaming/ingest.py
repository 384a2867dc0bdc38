"""Slot counts per (layer, expert) over a folder that shards are added to.

Each file is counted once: the checkpoint of the query remembers files, and a batch that is run again
replaces what it wrote before, because its output is keyed by the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SLOTS = "doc_id long, pos int, layer int, expert int"


def slots_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SLOTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes counts of each micro-batch to ``out/batch=N`` until the source has no more files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("layer", "expert").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """``layer, expert, n`` over all batches."""
    return spark.read.parquet(out).groupBy("layer", "expert").agg(F.sum("n").alias("n"))


def live_counts(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Running counts as a memory table, updated with each batch."""
    counts = stream.groupBy("layer", "expert").agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
