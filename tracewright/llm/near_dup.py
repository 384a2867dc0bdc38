"""Near-duplicate documents with SetSketch registers.

1. A document's set is its distinct five-word shingles (64-bit hashes). Its sketch has REGISTERS
   registers: register i is ``floor(1 - log_b(least exponential variate that hash i gives an element))``,
   so sketches merge by maximum and two sets agree in a register with a probability close to their
   similarity. Documents with equal sets form one class and only classes go on.
2. ROWS registers make a band; classes with equal registers in a band are candidates. The similarity
   of candidates is estimated from all registers jointly, by likelihood; clearly dissimilar pairs go.
3. What is left is verified on the full sets, as far as it can still join two components: first each
   class against the band leader that it shares most bands with, then, within the bands that still hold
   several components, the members outside the band's largest component against all others, in blocks
   of bounded rows and bytes.

Two sets of similarity 0.75 share no band with a probability of (1 - 0.75**4)**48 = 1.2e-8.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import alone, connected_components, written

BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
#: Parameters of the registers: base, rate of the exponential variates, largest value.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
#: An estimate this much below the threshold (5 standard deviations) rules a pair out.
SLACK = 0.155
#: Members of a band that are compared at a time, on each side, and hashes in their full sets.
BLOCK, HASHES = 1024, 1 << 21
KEPT_WORDS = 200_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
_FLIP = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
#: Odd multipliers of the words of a shingle, by place.
_PLACES = [np.uint64(int(x) | 1) for x in _rng.integers(0, 1 << 63, 8, dtype=np.uint64)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8: A-Z lower-cased, words parted by
    ASCII white space. A shorter text is one shingle; one without words has none."""
    if not text:
        return np.empty(0, np.uint64)
    if len(_WORDS) > KEPT_WORDS:
        _WORDS.clear()
    found = list(map(_WORDS.__getitem__, text.lower().split()))
    h = np.array(found, np.uint64)
    n = len(h)
    with np.errstate(over="ignore"):
        size = min(n, words)
        if n == 0:
            return h
        key = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            key = _mix(key + h[k : n - size + 1 + k] * _PLACES[k])
    return np.unique(key)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of hashes; of the empty set all are 0."""
    if not len(elements):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full((REGISTERS, 1), 0xFFFFFFFF, np.uint32)
    short = (elements >> np.uint64(32)).astype(np.uint32) ^ elements.astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 1024):
            part = (short[None, at : at + 1024] ^ _FLIP) * _MULTIPLY
            part ^= part >> np.uint32(16)
            np.minimum(low, part.min(axis=1, keepdims=True), out=low)
    least = -np.log1p(-(low[:, 0] + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, rounds: int = 14) -> np.ndarray:
    """Likeliest similarity of pairs of sets, from the numbers of registers in which one or the other
    is larger and from the sets' known sizes. Rows of ``a`` and ``b`` are sketches.

    With u and v the shares of the sizes in their sum, a register of the first set is the larger one
    with probability q(u - vJ), of the second with q(v - uJ), where q(x) = -log_b(1 - x(b-1)/b). The
    log likelihood is concave in J; its slope is bisected on the range that the sizes allow."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = n_a / np.maximum(n_a + n_b, 1)
    v = 1 - u
    c = (BASE - 1) / BASE
    q = lambda x: -np.log1p(-x * c) / np.log(BASE)
    dq = lambda x: c / (1 - x * c) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            j = (low + high) / 2
            x, y = u - v * j, v - u * j
            slope = same * (v * dq(x) + u * dq(y)) / (1 - q(x) - q(y)) - up * v * dq(x) / q(x) - down * u * dq(y) / q(y)
            rise = slope > 0
            low, high = np.where(rise, j, low), np.where(rise, high, j)
    return (low + high) / 2


def similar(a: np.ndarray, b: np.ndarray, numerator: int, denominator: int) -> bool:
    """Whether intersection / union >= numerator / denominator, on full sets of hashes."""
    if min(len(a), len(b)) * denominator < max(len(a), len(b)) * numerator:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * denominator >= (len(a) + len(b) - both) * numerator


def _sets(texts: pa.Array, words: int):
    for text in texts.cast(pa.binary()).to_pylist():
        yield shingles(text, words)


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``id, mark, key, n, bands`` of each row: the text's hash, the set's 128-bit key, its size, and the
    registers as one long per band. Key and bands of an empty set are null."""

    def run(batches):
        alone("near_dup", _WORDS.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                here = batch.slice(at, 512)
                keys, sizes, bands = [], [], []
                for s in _sets(here.column(2), words):
                    keys.append(_key(s) if len(s) else None)
                    sizes.append(len(s))
                    bands.append(registers(s).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "mark", "key", "n", "bands"])

    return docs.mapInArrow(run, "id long, mark long, key binary, n long, bands array<long>")


def _matrix(bands: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = np.array(bands.combine_chunks().flatten() if isinstance(bands, pa.ChunkedArray) else bands.flatten(), np.int64)
    return flat.view(np.uint16).reshape(-1, REGISTERS)


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, hashes`` of the classes ``wanted(node, id, mark, key)``: their sets again, from the text of
    the class's first document. Rows are found by id and hash of the text together, so rows without an
    id, or with one that others have, meet nothing but copies of their text, of which one is taken."""
    texts = docs.select(F.col("id").alias("at"), F.col("mark").alias("of"), "text")
    rows = wanted.join(texts, (F.col("mark") == F.col("of")) & F.col("id").eqNullSafe(F.col("at"))).select("node", "key", "text").dropDuplicates(["node"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                here = batch.slice(at, 512)
                nodes, blobs = [], []
                for node, key, s in zip(here.column(0).to_pylist(), here.column(1).to_pylist(), _sets(here.column(2), words)):
                    if _key(s) == key:
                        nodes.append(node)
                        blobs.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes binary")


def near_duplicates(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", words: int = 5, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row.

    Rows are linked if intersection / union of their shingle sets is at least numerator / denominator;
    every link is confirmed on full sets. ``component_id`` is the least id reachable by links and
    ``kept`` marks the rows that have it as their own. A row without words is linked with nothing. A
    null id never becomes a component's id unless all its members have null; then ``component_id`` is
    null and all are kept, as no id tells them apart. Rows that repeat an id are rows of their own,
    and each that has its component's id is kept. Columns other than the two named don't matter. An
    empty table gives an empty result.

    Equal sets are one class, found by a grouped minimum, so a large group of copies is never paired.
    No pair within a group is ever a row: candidates are compared inside blocks of about BLOCK classes
    or HASHES set elements a side, and only links that join components come out. In a band, what is
    outside its largest component, of size s, meets all n members: work is s * n, quadratic only where
    many classes share a band and the first pass joined few of them.
    """
    threshold = numerator / denominator
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("mark"), F.col(text_column).alias("text"))
    sketch = written(sketches(own, words), folder, "sketches")
    grouped = sketch.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    grouped = grouped.select("key", "least.id", "least.mark", "n", "bands")
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), folder, "classes")

    # A bucket's last six bits are its band.
    rows = classes.select("node", F.posexplode("bands").alias("band", "value"))
    rows = rows.select("node", F.xxhash64("band", "value").bitwiseAND(F.lit(-64)).bitwiseOR(F.col("band").cast("long")).alias("bucket"))
    leaders = written(rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("bucket", "leader"), folder, "leaders")
    members = written(rows.join(leaders, "bucket"), folder, "members")

    # First pass: each class and the leader with which it shares most bands.
    pairs = members.where("node <> leader").groupBy("node", "leader").count()
    best = pairs.groupBy("node").agg(F.max(F.struct("count", F.negative("leader").alias("minus"))).alias("m")).select("node", F.negative("m.minus").alias("leader"))
    best = written(best, folder, "best")
    side = lambda tag: classes.select(F.col("node").alias(f"node_{tag}"), F.col("n").alias(f"n_{tag}"), F.col("bands").alias(f"bands_{tag}"))
    near = best.join(side("a"), F.col("node") == F.col("node_a")).join(side("b"), F.col("leader") == F.col("node_b"))
    near = near.select("node_a", "node_b", "n_a", "n_b", "bands_a", "bands_b")

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(k).to_numpy().astype(float) for k in (2, 3)]
                j = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), *sizes)
                yield batch.filter(pa.array(j >= threshold - SLACK)).select([0, 1])

    near = written(near.mapInArrow(likely, "node_a long, node_b long"), folder, "near")
    names = classes.select("node", "id", "mark", "key")
    wanted = near.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    full = written(_full_sets(own, names.join(wanted, "node", "left_semi"), words), folder, "sets1")
    ends = lambda tag: full.select(F.col("node").alias(f"at_{tag}"), F.col("hashes").alias(f"hashes_{tag}"))

    def confirm(batches):
        for batch in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
            yield batch.filter(pa.array([similar(a, b, numerator, denominator) for a, b in zip(*sets)], pa.bool_())).select([0, 1])

    checked = near.join(ends("a"), near.node_a == F.col("at_a")).join(ends("b"), F.col("node_b") == F.col("at_b")).select("node_a", "node_b", "hashes_a", "hashes_b")
    links = written(checked.mapInArrow(confirm, "a long, b long"), folder, "links1")
    label = connected_components(links, folder, "first")

    # Second pass: bands that still hold several components. Of buckets with the same members the first
    # band's is enough, and the members of a bucket's largest component meet those outside it only.
    labelled = members.select("bucket", "node").join(label.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    labelled = written(labelled.join(classes.select(F.col("node").alias("of"), "n"), F.col("node") == F.col("of")).drop("of"), folder, "labelled")
    mixed = F.xxhash64("node", F.lit(3)).cast("decimal(38,0)")
    open_ = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), F.sum("n").alias("hashes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(mixed).alias("y")).where("low < high")
    open_ = open_.groupBy("size", "x", "y").agg(F.min(F.struct(F.col("bucket").bitwiseAND(F.lit(63)).alias("band"), "bucket", "hashes")).alias("m")).select("m.bucket", "size", "m.hashes")
    open_ = written(open_, folder, "open")
    parts = written(labelled.join(open_.select("bucket"), "bucket", "left_semi").groupBy("bucket", "root").agg(F.count("*").alias("size"), F.sum("n").alias("hashes")), folder, "parts")
    largest = parts.groupBy("bucket").agg(F.max(F.struct("size", "hashes", "root")).alias("m"))
    blocks = lambda size, hashes: F.greatest(F.lit(1), F.ceil(size / BLOCK), F.ceil(hashes / HASHES)).cast("int")
    open_ = open_.join(largest, "bucket").select("bucket", F.col("m.root").alias("main"), blocks(F.col("size") - F.col("m.size"), F.col("hashes") - F.col("m.hashes")).alias("rows"), blocks(F.col("size"), F.col("hashes")).alias("columns"))
    open_ = written(open_, folder, "dealing")
    # A pair of blocks (i, j) compares the outsiders of block i, side 0, with all members of block j, side 1.
    dealt = labelled.select("bucket", "node", "root").join(open_, "bucket")
    lot = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    outside = dealt.where("root <> main").select("bucket", lot(1, F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), F.lit(0).alias("side"), "node", "root", "main")
    inside = dealt.select("bucket", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), lot(2, F.col("columns")).alias("j"), F.lit(1).alias("side"), "node", "root", "main")
    dealt = written(outside.unionByName(inside), folder, "dealt")
    sized = dealt.join(classes.select(F.col("node").alias("of"), "n", "bands"), F.col("node") == F.col("of")).select("bucket", "i", "j", "side", "node", "root", "main", "n", "bands")

    def plausible(table: pa.Table):
        """Index pairs of a block pair that may be links between components: an outsider and a member of
        another component, each two outsiders once, that share no earlier band and are alike by size and
        by estimate."""
        side, node, root, main, n = (table.column(c).to_numpy() for c in ("side", "node", "root", "main", "n"))
        regs = _matrix(table.column("bands"))
        bands = regs.view(np.int64)
        band = table.column("bucket")[0].as_py() & 63
        rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for low in range(0, len(rows), 32):
            some = rows[low : low + 32, None]
            able = (root[columns] != root[some]) & ((node[columns] > node[some]) | (root[columns] == main[columns]))
            able &= np.minimum(n[columns], n[some]) * denominator >= np.maximum(n[columns], n[some]) * numerator
            first, second = np.nonzero(able)
            first, second = rows[low + first], columns[second]
            for at in range(0, len(first), 8192):
                a, b = first[at : at + 8192], second[at : at + 8192]
                near = (bands[a] == bands[b]).argmax(axis=1) == band
                a, b = a[near], b[near]
                near = (regs[a] == regs[b]).sum(axis=1) >= (threshold - SLACK) * REGISTERS * 0.9
                a, b = a[near], b[near]
                if len(a):
                    near = estimate(regs[a], regs[b], n[a].astype(float), n[b].astype(float)) >= threshold - SLACK
                    yield from zip(a[near].tolist(), b[near].tolist())

    def active(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        at = sorted({x for pair in plausible(table) for x in pair})
        return table.select(["bucket", "i", "j", "side", "node", "root", "main", "n", "bands"]).take(pa.array(at, pa.int64()))

    active_schema = "bucket long, i int, j int, side int, node long, root long, main long, n long, bands array<long>"
    some = written(sized.groupBy("bucket", "i", "j").applyInArrow(active, active_schema), folder, "active")
    missing = some.select("node").distinct().join(full.select("node"), "node", "left_anti")
    more = written(_full_sets(own, names.join(missing, "node", "left_semi"), words), folder, "sets2")
    sets = full.unionByName(more).select(F.col("node").alias("of"), "hashes")
    armed = some.join(sets, F.col("node") == F.col("of")).drop("of")

    def join_components(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        parent = {r: r for r in root.tolist()}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for a, b in plausible(table):
            x, y = top(int(root[a])), top(int(root[b]))
            if x != y and similar(hashes[a], hashes[b], numerator, denominator):
                parent[x] = y
                out.append((int(node[a]), int(node[b])))
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    joins = written(armed.groupBy("bucket", "i", "j").applyInArrow(join_components, "a long, b long"), folder, "links2")
    label = connected_components(links.unionByName(joins), folder, "second") if not joins.isEmpty() else label

    rooted = written(names.drop("mark").join(label.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "id", F.coalesce("root", "node").alias("root")), folder, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("id").alias("component_id")).withColumnRenamed("root", "to"), folder, "least")
    named = written(rooted.join(least, F.col("root") == F.col("to")).select(F.col("key").alias("of"), "component_id"), folder, "named")
    with_words = sketch.where("key IS NOT NULL").select("id", "key", "n").join(named, F.col("key") == F.col("of")).select("id", "n", "component_id")
    without = sketch.where("key IS NULL").select("id", "n", F.col("id").alias("component_id"))
    out = reduce(DataFrame.unionByName, [with_words, without])
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

