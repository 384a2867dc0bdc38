"""Cut lineage and ranks that hold at any size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checks import Refused


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from ``spark.checkpoint.dir``. Where it is unset a
    session in one process (local mode) gets a temporary one; a cluster is refused, as its executors would
    each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise Refused("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` as a table in the shared folder with a folder per value of ``keys``, so that a filter on them
    reads its rows only."""
    target = f"{shared_dir(df.sparkSession).rstrip('/')}/tracewright-{uuid.uuid4().hex}"
    df.write.partitionBy(*keys).parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def running(df: DataFrame, keys: Sequence[str], part: Column, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one among those with equal keys.

    ``part`` is a coarse prefix of the order (it must rise with it). Sums per (keys, part) are added up
    first, over one row per part; the rows themselves are only ordered within their part. So a key that
    holds most of the rows is still dealt to many tasks.
    """
    rows = df.withColumns({"_part": part, "_value": value})
    parts = rows.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, [*keys, "_part"]).withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return rows.drop("_part", "_value", "_start")
