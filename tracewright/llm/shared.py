"""What the training-data operators share: the shared work folder, written tables, file access
from executors, and connected components over a distributed link table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_dir


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lowers the bytes of a batch between the JVM and Python workers for the session, where they have
    Spark's default: 64 MB of texts would be held on both sides by every task. A value that the user has
    chosen stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(most))


_CACHES: dict[str, Callable] = {}


def alone(name: str, clear: Callable) -> None:
    """Says that the kernel ``name`` of this worker process keeps a cache that ``clear`` empties, and
    empties those of all other kernels: a worker that one session uses for several operators holds one
    operator's cache at a time."""
    for other in [k for k in _CACHES if k != name]:
        _CACHES.pop(other)()
    _CACHES[name] = clear


def work_dir(spark: SparkSession) -> str:
    """A fresh folder URI below ``spark.checkpoint.dir``, removed when the driver's JVM ends.

    The folder is the one that driver and executors share. Where the setting is absent, a session in one
    process gets a temporary folder and a cluster is refused (``shared_dir``).
    """
    small_batches(spark)
    base = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tracewright-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    uri = path.toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def drop_dir(spark: SparkSession, uri: str) -> None:
    """Removes a folder that no later plan reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes ``df`` as parquet below ``folder`` and reads it back: cuts the lineage with a table
    that outlives any executor."""
    target = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def open_fs(uri: str):
    """pyarrow filesystem and path of a URI, as an executor opens it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def connected_components(edges: DataFrame, folder: str, tag: str, max_rounds: int = 200) -> DataFrame:
    """Connected components of the undirected links ``edges(a, b)`` of longs.

    Returns ``(node, root)`` for every node that has a link; ``root`` is the same for all nodes of a
    component and names one of them. Repeated links, both directions and self-links are allowed;
    rows with a null end are ignored. An empty table gives an empty result.

    Random-priority contraction: each round every node adopts the neighbour (or itself) whose hash
    is least, links are rewritten to the adopted nodes, and the rounds end when no link is left.
    The expected number of nodes falls by a constant factor in each round, whatever the shape of the
    component. Minima aggregate before the shuffle and both inputs of each join are written tables,
    so that a hub's rows can be split between tasks.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = written(both(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")).distinct(), folder, f"{tag}-links0")
    parents = []
    while not live.isEmpty():
        k = len(parents) + 1
        if k > max_rounds:
            raise RuntimeError(f"links are left after {max_rounds} contraction rounds")
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)), F.col(c).alias("id"))  # noqa: E731, B023
        least = live.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a"))["id"].alias("parent"))
        parent = written(least, folder, f"{tag}-parent{k}")
        parents.append(parent)
        half = live.join(parent, live.a == parent.node).select(F.col("parent").alias("a"), "b")
        half = written(half.distinct(), folder, f"{tag}-half{k}")
        full = half.join(parent, half.b == parent.node).select("a", F.col("parent").alias("b")).where("a <> b")
        live = written(full.distinct(), folder, f"{tag}-links{k}")
    if not parents:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = parents[0].select("node", F.col("parent").alias("root"))
    for k, parent in enumerate(parents[1:], 2):
        step = parent.select(F.col("node").alias("at"), "parent")
        labels = labels.join(step, labels.root == step.at, "left").select("node", F.coalesce("parent", "root").alias("root"))
        labels = written(labels, folder, f"{tag}-labels{k}")
    return labels
