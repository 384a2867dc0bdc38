"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors are ordered lexicographically by a string of random hashes, the sides of
random hyperplanes through the vectors' mean, and each is compared with the next WINDOW in that order.
Pairs that pass the exact test are united, over all passes. Neither windows nor passes are a limit on
the result. Afterwards the vectors are cut into blocks of cells, each with a centre and a radius; two
cells are left out only if the triangle inequality proves that no pair between them can be linked, and
all others are compared, which finds every link between components. Then all pairs inside a component
are compared: small components together, a large one in tiles, each a single row, that meet tile by tile,
so the links of a vector are counted in full however large its group is.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, open_fs, written
from .vectors import as_rows, finite, matrix

#: Passes that are sorted in one job: what bounds the disk that the shuffles take.
AT_ONCE = 4
#: Rows of a tile of the windows, and of a large component.
TILE, PACKED = 512, 2048
#: Rows of a block, which a task holds two of, and of a cell, which has a centre and a radius.
BLOCK, CELL = 4096, 256
#: What rounding can add to a distance between unit vectors, with room to spare.
SLACK = 1e-6


def hyperplanes(dim: int, one_pass: int) -> np.ndarray:
    """The 63 normals of a pass."""
    return np.random.default_rng([71, dim, one_pass]).standard_normal((dim, 63))


def keys(units: np.ndarray, mean: np.ndarray, one_pass: int) -> np.ndarray:
    """The hashes of a pass, the first in the highest bit, as longs that sort like the strings."""
    sides = (units - mean) @ hyperplanes(units.shape[1], one_pass) > 0
    return sides.astype(np.int64) @ (np.int64(1) << np.arange(62, -1, -1, dtype=np.int64))


def unit(points: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that no square over- or underflows."""
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def groups(linked: np.ndarray) -> np.ndarray:
    """The least index reachable from each row of a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def ball(units: np.ndarray) -> tuple[np.ndarray, float]:
    """The centre of some rows and the largest distance from it."""
    centre = units.mean(axis=0)
    return centre, float(np.sqrt(((units - centre) ** 2).sum(axis=1).max()))


def near(centre: np.ndarray, radius: np.ndarray, centres: np.ndarray, radii: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of balls can hold two unit vectors with a cosine of at least ``threshold``: those lie
    within sqrt(2 - 2 * threshold) of each other."""
    squares = (centre * centre).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * centre @ centres.T
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    return np.sqrt(np.maximum(squares, 0)) <= radius[:, None] + radii[None, :] + reach


def passes_for(n: int, window: int, threshold: float, miss: float) -> int:
    """Passes after which two vectors at the threshold, among ``n`` that lie about evenly around the mean,
    have met in a window but for a probability of ``miss``: they agree in a hash with probability
    1 - angle / pi and meet in one pass if they agree in log2(n / window) hashes. At least 4."""
    agree = 1 - np.arccos(min(1.0, max(-1.0, threshold))) / np.pi
    meet = agree ** max(0.0, np.log2(max(n, 1) / window))
    return max(4, int(np.ceil(np.log(miss) / np.log1p(-min(meet, 1 - 1e-9)))))


def bridges(rows: DataFrame, means: dict[int, np.ndarray], folder: str, threshold: float) -> DataFrame:
    """``a, b``: the roots of each two components that a link joins, from ``rows(dim, node, root, v)``.

    Exact. Blocks are files in the shared folder, listed in a table that only finished tasks write to; a
    task reads that table and compares its blocks with half of the others round the circle, so that
    every two blocks meet once and all tasks have the same work. Nothing is shuffled but the rows, once.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def hashed(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim, at in _by_dim(dims):
                some = batch.take(pa.array(at))
                key = keys(unit(matrix(some.column(3), dim)), means[dim], 0)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(key), *(some.column(k) for k in (1, 2, 3))], names=["dim", "key", "node", "root", "v"])

    def block(held: pa.Table, dim: int) -> pa.RecordBatch:
        held = held.combine_chunks()
        centre, radius = ball(unit(matrix(held.column("v").combine_chunks(), dim)))
        fs, path = open_fs(f"{folder}/blocks/{uuid.uuid4().hex}")
        with fs.open_output_stream(path) as out, pa.ipc.new_file(out, held.schema) as file:
            file.write_table(held)
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "name": [path.rsplit("/", 1)[1]], "centre": [centre.tolist()], "radius": [radius]})

    def cut(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch]).select(["dim", "root", "v"])
            held = now if held is None else pa.concat_tables([held, now])
            while held.num_rows:
                dims = held.column("dim").to_numpy()
                n = int(np.searchsorted(dims, dims[0], side="right"))
                if n < BLOCK and n == held.num_rows:
                    break
                n = min(n, BLOCK)
                yield block(held.slice(0, n).select(["root", "v"]), int(dims[0]))
                held = held.slice(n)
        if held is not None and held.num_rows:
            yield block(held.select(["root", "v"]), int(held.column("dim")[0].as_py()))

    order = ["dim", "key", "node"]
    kind = dict(rows.dtypes)["v"]
    ordered = rows.mapInArrow(hashed, f"dim int, key long, node long, root long, v {kind}").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks"))
    listed = written(ordered.mapInArrow(cut, "dim int, name string, centre array<double>, radius double"), folder, "blocks-listed")

    def read(name: str, dim: int):
        fs, path = open_fs(f"{folder}/blocks/{name}")
        with fs.open_input_file(path) as file:
            held = pa.ipc.open_file(file).read_all().combine_chunks()
        units = unit(matrix(held.column("v").combine_chunks(), dim))
        cells = [ball(units[at : at + CELL]) for at in range(0, len(units), CELL)]
        return held.column("root").to_numpy(), units, np.array([c for c, _ in cells]), np.array([r for _, r in cells])

    def compare(batches):
        import pyarrow.parquet as pq

        fs, path = open_fs(f"{folder}/blocks-listed")
        every = pq.read_table(path, filesystem=fs)
        every = every.take(pa.array(np.lexsort((every.column("name").to_numpy(zero_copy_only=False), every.column("dim").to_numpy()))))
        names, dims = every.column("name").to_pylist(), every.column("dim").to_numpy()
        place = {name: k for k, name in enumerate(names)}
        balls = {}
        for dim, at in _by_dim(dims):
            of = every.take(pa.array(at))
            balls[dim] = int(at[0]), matrix(of.column("centre").combine_chunks(), dim), of.column("radius").to_numpy()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                dim = int(dims[place[name]])
                start, centres, radii = balls[dim]
                own, n = place[name] - start, len(radii)
                roots, units, cells, far = read(name, dim)
                able = near(centres[own : own + 1], radii[own : own + 1], centres, radii, threshold)[0]
                for step in range(n // 2 + 1):
                    other = (own + step) % n
                    if not able[other] or (step and 2 * step == n and own >= other):
                        continue
                    roots2, units2, cells2, far2 = read(names[start + other], dim) if step else (roots, units, cells, far)
                    found = []
                    for k, row in enumerate(near(cells, far, cells2, far2, threshold)):
                        at = np.flatnonzero(np.repeat(row, CELL)[: len(units2)])
                        if not len(at):
                            continue
                        mine = slice(k * CELL, (k + 1) * CELL)
                        i, j = np.nonzero(units[mine] @ units2[at].T >= threshold)
                        a, b = roots[mine][i], roots2[at[j]]
                        apart = a != b
                        if apart.any():
                            found.append(np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0))
                    if found:
                        found = np.unique(np.concatenate(found), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    dealt = listed.select("name").repartition(max(parts, spark.sparkContext.defaultParallelism), "name")
    return written(dealt.mapInArrow(compare, "a long, b long").distinct(), folder, "bridges")


def _by_dim(dims: np.ndarray):
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def components(vectors: DataFrame, folder: str, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", passes: int | None = None, window: int = 64, miss: float = 0.01) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Two rows are linked if their cosine, in double precision, is at least ``threshold``; none below
    it is. Vectors that are null, zero or empty, or hold null or non-finite components, are linked
    with nothing; nor are vectors of different lengths. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the least id reachable, ``kept`` says whether that is the row's
    own; among rows without an id component_id may be null, and they are kept then. Rows that repeat
    an id are rows of their own. An empty table gives an empty result; other columns don't matter.

    Equal vectors are one class with a weight, so copies are never compared. The number of ``passes``
    follows from the number of classes (``passes_for``), so that it rises with the table's logarithm and
    the share of pairs they miss does not: 11 for 50,000 classes, 39 for 100 million. What passes and
    windows miss is found by ``bridges``, which is exact: they change the time, not the result. Where the
    vectors are so spread out that no two cells can be told apart, that step compares all pairs of classes.
    """
    own = as_rows(vectors, id_column, vector_column)
    single = dict(own.dtypes)["v"] == "array<float>"
    kind = np.float32 if single else np.float64
    lists = pa.list_(pa.float32() if single else pa.float64())
    part = finite("v") & F.exists("v", lambda x: x != 0)

    def digest(batches):
        for batch in batches:
            found = [None if v is None else xxhash.xxh3_128_digest((np.asarray(v, kind) + 0).tobytes()) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "v", "key"])

    table = own.select("id", F.when(part, F.col("v")).alias("v")).mapInArrow(digest, f"id long, v {dict(own.dtypes)['v']}, key binary")
    table = written(table, folder, "vectors")
    grouped = table.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), folder, "classes")
    points = classes.select("node", F.size("v").alias("dim"), "v")

    def add_up(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim, at in _by_dim(dims):
                total = unit(matrix(batch.column(2).take(pa.array(at)), dim)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total), pa.array(np.full(dim, len(at), np.int64))], names=["dim", "at", "total", "n"])

    means: dict[int, np.ndarray] = {}
    sums = points.mapInArrow(add_up, "dim int, at int, total double, n long").groupBy("dim", "at").agg(F.sum("total").alias("s"), F.sum("n").alias("n"))
    n_classes: dict[int, int] = {}
    for r in sums.collect():
        means.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = round(r["s"] / r["n"], 9)
        n_classes[r["dim"]] = r["n"]
    if passes is None:
        passes = passes_for(sum(n_classes.values()), window, threshold, miss)

    def hashed(some):
        def run(batches):
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for dim, at in _by_dim(dims):
                    at = pa.array(at)
                    rows = batch.column(2).take(at)
                    units = unit(matrix(rows, dim))
                    for p in some:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), batch.column(1).take(at), pa.array(keys(units, means[dim], p)), batch.column(0).take(at), rows.cast(lists)], names=["pass", "dim", "key", "node", "v"])

        return run

    def windows(batches):
        """Compares each row with the next ``window`` in the partition's order; one link for each row
        that a tile's verified pairs connect to an earlier one."""
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            fresh = 0 if held is None else held.num_rows
            turn, dims, node = (now.column(c).to_numpy() for c in ("pass", "dim", "node"))
            for low in range(fresh, now.num_rows, TILE):
                first, high = max(0, low - window), min(now.num_rows, low + TILE)
                for dim, at in _by_dim(dims[first:high]):
                    at = at + first
                    units = unit(matrix(now.column("v").take(pa.array(at)).combine_chunks(), dim))
                    linked = units @ units.T >= threshold
                    linked &= (np.abs(at[:, None] - at[None, :]) <= window) & (turn[at][:, None] == turn[at][None, :])
                    label = groups(linked)
                    more = np.flatnonzero(label != np.arange(len(at)))
                    if len(more):
                        yield pa.RecordBatch.from_arrays([pa.array(node[at[more]]), pa.array(node[at[label[more]]])], names=["a", "b"])
            held = now.slice(max(0, now.num_rows - window)).combine_chunks()

    schema = f"pass int, dim int, key long, node long, v {dict(own.dtypes)['v']}"
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = None
    for at in range(0, passes, AT_ONCE):
        some = range(at, min(passes, at + AT_ONCE))
        # The last column mixes rows of equal keys anew in each pass, so that a group larger than a
        # partition's share meets in other parts each time.
        order = ["pass", "dim", "key", F.xxhash64("node", "pass")]
        ordered = points.mapInArrow(hashed(some), schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = written(ordered.mapInArrow(windows, "a long, b long").distinct(), folder, f"links{at}")
        links = found if links is None else links.unionByName(found)

    label = connected_components(links, folder, "passes")
    rooted = points.join(label.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("dim", "node", F.coalesce("root", "node").alias("root"), "v")
    missed = bridges(rooted, means, folder, threshold)
    if not missed.isEmpty():
        label = connected_components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(missed), folder, "joined")
    sizes = label.groupBy("root").count().withColumnRenamed("root", "of")
    placed = label.join(written(sizes, folder, "sizes"), F.col("root") == F.col("of")).select("node", "root", "count")
    total = label.count()
    lots = max(1, total // PACKED)
    placed = placed.withColumn("tiles", F.ceil(F.col("count") / PACKED).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    # Small components share a lot, which is compared as it is; a tile of a large one becomes one row.
    lot = F.when(F.col("tiles") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(lots)))
    placed = written(placed.select(lot.alias("lot"), "tiles", "tile", "node", "root"), folder, "placed")
    rows = placed.join(classes.select(F.col("node").alias("of"), "weight", "v"), F.col("node") == F.col("of")).drop("of")

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, root, weight = (group.column(c).to_numpy() for c in ("node", "root", "weight"))
        v = group.column("v").combine_chunks()
        linked_weight = np.zeros(len(node), np.int64)
        order = np.argsort(root, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            units = unit(matrix(v.take(pa.array(at)), len(v[int(at[0])])))
            linked = units @ units.T >= threshold
            np.fill_diagonal(linked, False)
            linked_weight[at] = linked @ weight[at]
        return pa.table({"node": node, "links": linked_weight})

    small = rows.where("tiles = 1").select("lot", "node", "root", "weight", "v").groupBy("lot").applyInArrow(count, "node long, links long")

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, group.schema) as file:
            file.write_table(group)
        return pa.table({"lot": group.column("lot")[:1], "tiles": group.column("tiles")[:1], "tile": group.column("tile")[:1], "data": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    tiles = rows.where("tiles > 1").select("lot", "tiles", "tile", "node", "weight", "v")
    tiles = written(tiles.groupBy("lot", "tile").applyInArrow(pack, "lot long, tiles int, tile int, data binary"), folder, "tiles")
    # Each tile meets itself first and then each other tile of its component: a task holds two at a time and
    # the counts of the first.
    meets = tiles.select(F.col("lot").alias("at"), F.col("tile").alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    meets = meets.join(tiles, (F.col("at") == F.col("lot")) & (F.col("other") == F.col("tile"))).select("lot", "own", (F.col("own") != F.col("other")).alias("apart"), "other", "data")
    meets = meets.repartition(parts, "lot", "own").sortWithinPartitions("lot", "own", "apart", "other")

    def opened(data: bytes):
        held = pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()
        v = held.column("v").combine_chunks()
        return held.column("node").to_numpy(), held.column("weight").to_numpy(), unit(matrix(v, len(v[0])))

    def meet(batches):
        node = units = counts = None
        result = lambda: pa.RecordBatch.from_arrays([pa.array(node), pa.array(counts)], names=["node", "links"])
        for batch in batches:
            for apart, data in zip(batch.column("apart").to_pylist(), batch.column("data")):
                other, weight, theirs = opened(data.as_buffer())
                if not apart:
                    if node is not None:
                        yield result()
                    node, units, counts = other, theirs, np.zeros(len(other), np.int64)
                linked = units @ theirs.T >= threshold
                if not apart:
                    np.fill_diagonal(linked, False)
                counts += linked @ weight
        if node is not None:
            yield result()

    counted = written(small.unionByName(meets.mapInArrow(meet, "node long, links long")), folder, "counted")
    named = classes.select("node", "key", "id", "weight").join(label.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "key", "id", "weight", F.coalesce("root", "node").alias("root"))
    named = named.join(counted.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "id", "root", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = written(named, folder, "named")
    least = written(named.groupBy("root").agg(F.min("id").alias("component_id")).withColumnRenamed("root", "to"), folder, "least")
    result = written(named.join(least, F.col("root") == F.col("to")).select(F.col("key").alias("of"), "n_links", "component_id"), folder, "result")
    linked = table.where("key IS NOT NULL").select("id", "key").join(result, F.col("key") == F.col("of")).select("id", "n_links", "component_id")
    alone = table.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
