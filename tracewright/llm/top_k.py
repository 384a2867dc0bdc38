"""Exact top-k search by inner product over KD-trees, one per shard.

Rows are dealt to shards of bounded size. A shard's tree is split at medians of its widest dimension
down to small leaves, and every node has the tight box of its rows. A query visits the nodes of a tree
best first, by the largest inner product that the box allows, and stops when none can reach the k-th
score it has. That score travels: a first round looks at each shard's most promising leaf, the k-th
best of all shards' finds is a lower bound for the whole, and the second round starts from it.

Trees and blocks of queries are tables in the shared folder. A task holds some trees and streams all
blocks past them, so nothing is shuffled for a pair of a tree and a block.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import open_fs, written
from .vectors import as_rows, finite, matrix

#: Rows of a shard, of a leaf, and queries of a block.
SHARD, LEAF, BLOCK = 4096, 256, 1024
#: Bytes of the trees that a task holds while the blocks pass.
HELD = 32 << 20
#: Sums of products below these are exact in doubles and in longs.
EXACT, LONG = float(1 << 53), float(1 << 63)
#: Components from this on have shards of their own, so that the others' stay in doubles.
LARGE = float(1 << 20)


def build(points: np.ndarray) -> dict:
    """A tree over integer rows (as doubles): the order of the rows, each leaf's first place, and the
    boxes of all nodes, the root first; node i has children 2i + 1 and 2i + 2."""
    n = len(points)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    order, cuts = np.arange(n), np.array([0, n])
    for _ in range(depth):
        middle = (cuts[:-1] + cuts[1:]) // 2
        for low, mid, high in zip(cuts[:-1], middle, cuts[1:]):
            if low < mid < high:
                part = points[order[low:high]]
                wide = int((part.max(axis=0) - part.min(axis=0)).argmax()) if part.shape[1] else 0
                if part.shape[1]:
                    order[low:high] = order[low:high][np.argpartition(part[:, wide], mid - low)]
        cuts = np.sort(np.concatenate([cuts, middle]))
    leaves = len(cuts) - 1
    low = np.full((2 * leaves - 1, points.shape[1]), np.inf)
    high = -low
    for k in range(leaves):
        rows = points[order[cuts[k] : cuts[k + 1]]]
        if len(rows):
            low[leaves - 1 + k], high[leaves - 1 + k] = rows.min(axis=0), rows.max(axis=0)
    for i in range(leaves - 2, -1, -1):
        low[i], high[i] = np.minimum(low[2 * i + 1], low[2 * i + 2]), np.maximum(high[2 * i + 1], high[2 * i + 2])
    return {"order": order, "cuts": cuts, "low": low, "high": high}


def bounds(tree: dict, queries: np.ndarray) -> np.ndarray:
    """At least the largest inner product of each query with any point of each node's box; -inf for a
    node without rows. What rounding can take off is added, and where a sum overflows it is infinite."""
    empty = ~np.isfinite(tree["low"]).all(axis=1)
    low, high = np.where(empty[:, None], 0, tree["low"]), np.where(empty[:, None], 0, tree["high"])
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        most = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
        out = np.where(most < EXACT, out, out + most * ((queries.shape[1] + 4) * 2.0**-50))
    out = np.where(np.isnan(out), np.inf, out)
    out[:, empty] = -np.inf
    return out


def scorer(points: np.ndarray, top: float, query: np.ndarray):
    """A function of (low, high): the exact integer scores of those points, whatever their size: in
    doubles or longs where these hold every partial sum, else in Python's integers. ``top`` is the
    largest component of the points."""
    own = np.abs(query).max(initial=0.0)
    most = top * own * max(1, points.shape[1])
    if most < EXACT:
        return lambda low, high: points[low:high] @ query
    if most < LONG and max(top, own) < LONG:
        whole = query.astype(np.int64)
        return lambda low, high: points[low:high].astype(np.int64) @ whole
    numbers = [int(x) for x in query.tolist()]
    return lambda low, high: np.array([sum(int(a) * b for a, b in zip(row, numbers)) for row in points[low:high].tolist()], object)


def search(tree: dict, score, rows: np.ndarray, ids: np.ndarray, own: int, bound: np.ndarray, k: int, floor, most_leaves: int | None = None) -> list[tuple]:
    """The k best (score, -id, -row) of a shard for one query, best first, of those that score at
    least ``floor``; fewer if fewer do. The row ``own`` is no candidate. ``score`` gives the scores of
    a range of places in tree order, in which rows and ids are. With ``most_leaves``, only so many
    leaves are looked at."""
    leaves = len(tree["cuts"]) - 1
    found: list[tuple] = []
    queue = [(-bound[0], 0)]
    seen = 0
    while queue:
        reach, node = heapq.heappop(queue)
        if -reach < floor or -reach == -np.inf:
            break
        if node < leaves - 1:
            for child in (2 * node + 1, 2 * node + 2):
                if bound[child] >= floor:
                    heapq.heappush(queue, (-bound[child], child))
            continue
        low, high = tree["cuts"][node - leaves + 1], tree["cuts"][node - leaves + 2]
        scores = score(low, high)
        good = np.flatnonzero((scores >= floor) & (rows[low:high] != own))
        if len(good):
            if len(good) > k and scores.dtype != object:
                order = np.lexsort((rows[low + good], ids[low + good], -scores[good]))[:k]
                good = good[order]
            found += [(int(scores[g]), -int(ids[low + g]), -int(rows[low + g])) for g in good]
            found = sorted(found, reverse=True)[:k]
            if len(found) == k:
                floor = max(floor, found[-1][0])
        seen += 1
        if most_leaves is not None and seen >= most_leaves:
            break
    return found


def beyond(score: int) -> bytes:
    """A key that sorts scores outside the range of a long, as bytes: one value for all within it."""
    if -(1 << 63) <= score < 1 << 63:
        return b"\x01"
    size = (abs(score).bit_length() + 7) // 8
    if score > 0:
        return b"\x02" + size.to_bytes(4, "big") + score.to_bytes(size, "big")
    return b"\x00" + bytes(255 - x for x in size.to_bytes(4, "big") + (-score).to_bytes(size, "big"))


def top_k(points: DataFrame, queries: DataFrame, folder: str, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row of ``queries``: its k highest inner products
    with rows of ``points`` after each component x became floor(scale * x), in double precision;
    ties go to the smaller vec_id.

    ``queries`` are rows of ``points``, told apart by the id: a query's own row is the one with its
    id, and of rows that repeat an id the first in the order of their components counts as the
    query's own for all of them. Vectors that are null or hold null or non-finite components, and
    rows without an id, take no part. Only vectors of the query's length are its candidates. With
    fewer than k candidates all are returned; empty tables give an empty result. A component whose
    product with ``scale`` overflows a double counts as non-finite. Scores are exact integers, however
    large; one outside the range of a long is ordered as it is and shown as the nearest long. Other
    columns don't matter.

    All queries meet all shards, as the search is exact, in blocks of BLOCK queries and SHARD rows;
    nothing else grows with the square of the input. A task reads all blocks once for each HELD bytes
    of trees.
    """
    spark = points.sparkSession
    scaled = F.transform("v", lambda x: F.lit(scale) * x.cast("double"))

    def whole(df):
        known = as_rows(df, id_column, vector_column).where(F.col("id").isNotNull() & finite("v"))
        return known.withColumn("_scaled", scaled).where(finite("_scaled")).select("id", F.transform("_scaled", _floor).alias("v"), F.size("v").alias("dim"))

    large = F.exists("v", lambda x: F.abs(x) >= LARGE)
    rows = written(whole(points).withColumns({"row": F.monotonically_increasing_id(), "large": large}), folder, "points")
    sizes = {r["large"]: r["n"] for r in rows.groupBy("large").agg(F.count("*").alias("n")).collect()}
    schema = "query_id long, rank int, vec_id long, score long"
    if not sizes:
        return spark.createDataFrame([], schema)
    first = Window.partitionBy("id").orderBy("v")
    asked = written(whole(queries).withColumn("place", F.row_number().over(first)).where("place = 1").drop("place"), folder, "asked")
    m = asked.count()
    # Shards of large components have the numbers from `usual` on.
    usual, others = -(-sizes.get(False, 0) // SHARD), -(-sizes.get(True, 0) // SHARD)
    shards, blocks = usual + others, -(-m // BLOCK)
    if not m:
        return spark.createDataFrame([], schema)
    own = Window.partitionBy("id").orderBy("v", "row")
    owners = rows.join(asked.select(F.col("id").alias("at")).distinct(), F.col("id") == F.col("at"), "left_semi").withColumn("place", F.row_number().over(own)).where("place = 1")
    owned = asked.join(owners.select(F.col("id").alias("at"), F.col("row").alias("own")), F.col("id") == F.col("at"), "left").select("id", "dim", "v", F.coalesce("own", F.lit(-1)).alias("own"))

    def plant(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table.column("dim")[0].as_py()
        at = matrix(table.column("v").combine_chunks(), dim)
        tree = build(at)
        o = tree["order"]
        held = {"tree": tree, "points": at[o], "rows": table.column("row").to_numpy()[o], "ids": table.column("id").to_numpy()[o]}
        return pa.table({"shard": [table.column("shard")[0].as_py()], "dim": [dim], "tree": [pickle.dumps(_small(held))]}, schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("tree", pa.binary())]))

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table.column("dim")[0].as_py()
        held = {"points": matrix(table.column("v").combine_chunks(), dim), "ids": table.column("id").to_numpy(), "own": table.column("own").to_numpy()}
        return pa.table({"block": [table.column("block")[0].as_py()], "dim": [dim], "asked": [pickle.dumps(held)]}, schema=pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("asked", pa.binary())]))

    lot = F.when(F.col("large"), usual + F.pmod(F.xxhash64("row"), F.lit(max(1, others)))).otherwise(F.pmod(F.xxhash64("row"), F.lit(max(1, usual))))
    dealt = rows.withColumn("shard", lot.cast("int"))
    trees = written(dealt.groupBy("shard", "dim").applyInArrow(plant, "shard int, dim int, tree binary"), folder, "trees")
    dealt = owned.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asks = written(dealt.groupBy("block", "dim").applyInArrow(gather, "block int, dim int, asked binary"), folder, "blocks")
    kinds = [("query_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary()), ("vec_id", pa.int64()), ("row", pa.int64())]
    tasks = max(1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def visit(table: str, most_leaves):
        """Scores of the blocks in ``table`` against the trees that the task holds."""

        def blocks_of():
            import pyarrow.dataset as ds

            fs, path = open_fs(f"{folder}/{table}")
            for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=1, batch_readahead=1, fragment_readahead=1):
                yield from batch.to_pylist()

        def pass_by(trees):
            held = [(dim, _whole(pickle.loads(tree))) for dim, tree in trees]
            tops = [np.abs(tree["points"]).max(initial=0.0) for _, tree in held]
            for row in blocks_of():
                block = pickle.loads(row["asked"])
                known = pickle.loads(row["floors"]) if row.get("floors") else ([], [])
                floor = dict(zip(*known))
                out: list[tuple] = []
                for (dim, tree), top in zip(held, tops):
                    if dim != row["dim"]:
                        continue
                    reach = bounds(tree["tree"], block["points"])
                    for q, (name, mine) in enumerate(zip(block["ids"].tolist(), block["own"].tolist())):
                        score = scorer(tree["points"], top, block["points"][q])
                        best = search(tree["tree"], score, tree["rows"], tree["ids"], mine, reach[q], k, floor.get(name, -np.inf), most_leaves)
                        out += [(name, max(-(1 << 63), min((1 << 63) - 1, s)), beyond(s), -i, -r) for s, i, r in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], schema=pa.schema(kinds))

        def run(batches):
            trees, size = [], 0
            for batch in batches:
                for dim, tree in zip(batch.column("dim").to_pylist(), batch.column("tree").to_pylist()):
                    trees.append((dim, tree))
                    size += len(tree)
                    if size >= HELD:
                        yield from pass_by(trees)
                        trees, size = [], 0
            if trees:
                yield from pass_by(trees)

        return trees.select("shard", "dim", "tree").repartition(tasks, "shard").mapInArrow(run, "query_id long, score long, beyond binary, vec_id long, row long")

    def floors(table: pa.Table) -> pa.Table:
        known = zip(table.column("query_id").to_pylist(), table.column("score").to_pylist(), table.column("beyond").to_pylist())
        # A floor outside the range of a long is left out: it only saves time.
        held = pickle.dumps(tuple(zip(*[(q, s) for q, s, b in known if b == b"\x01"])) or ([], []))
        return pa.table({"block": [table.column("block")[0].as_py()], "floors": [held]}, schema=pa.schema([("block", pa.int32()), ("floors", pa.binary())]))

    ranked = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id", "row")
    seeds = visit("blocks", 1)
    kth = seeds.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", "score", "beyond")
    kth = kth.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    known = written(kth.groupBy("block").applyInArrow(floors, "block int, floors binary"), folder, "floors")
    written(asks.join(known, "block", "left").select("block", "dim", "asked", "floors"), folder, "asked-again")
    best = visit("asked-again", None)
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floor(x):
    """Floor of a double as a double, beyond the range of a long too, where it is whole already."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _small(held: dict) -> dict:
    """Integers instead of doubles where 16 or 32 bits hold them."""
    top = np.abs(held["points"]).max(initial=0)
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64
    return held | {"points": held["points"].astype(kind)}


def _whole(held: dict) -> dict:
    return held | {"points": held["points"].astype(np.float64)}
