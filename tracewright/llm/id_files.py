"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A shard file holds the ids of its documents one after another (16-bit where the vocabulary allows it,
else 32-bit), then two Elias-Fano sequences, the boundaries in the id array and the document ids,
then a JSON footer, its length (4 bytes) and a mark. A sequence of n values below u takes about
``2 + log2(u / n)`` bits a value; ``select`` returns one value from a sampled position and a scan of
the upper bits, so no table of 64-bit offsets is ever built to find one document.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import library_table
from .shared import open_fs

MARK = b"EFID0001"
#: Ones of the upper bits between two sampled positions.
SAMPLE = 256
#: Values whose lower bits are spread out at a time; a multiple of 8, so that each slice ends on a byte.
SLICE = 1 << 14


class EliasFano:
    """A non-decreasing sequence of integers in [0, 2**63).

    ``pack`` gives the coded bytes and ``unpack`` a sequence over such bytes; ``select(i)`` is the
    i-th value and ``values(i, j)`` those of a range.
    """

    def __init__(self, count: int, width: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.count, self.width, self.lower, self.upper, self.samples = count, width, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint32))
        if (values[1:] < values[:-1]).any():
            raise ValueError("the sequence decreases")
        top = int(values[-1])
        width = max(0, (top // n).bit_length() - 1)
        places = np.arange(width, dtype=np.uint64)
        lower = np.empty((n * width + 7) // 8, np.uint8)
        for at in range(0, n, SLICE):
            bits = ((values[at : at + SLICE, None] >> places) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bits.ravel(), bitorder="little")
            lower[at * width // 8 : at * width // 8 + len(packed)] = packed
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, width, lower, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def pack(self) -> bytes:
        return b"".join([np.array([self.count, self.width, len(self.lower), len(self.upper), len(self.samples)], "<u8").tobytes(), self.lower.tobytes(), self.upper.tobytes(), self.samples.astype("<u4").tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        n, width, a, b, c = (int(x) for x in np.frombuffer(data, "<u8", 5))
        return cls(n, width, np.frombuffer(data, np.uint8, a, 40), np.frombuffer(data, np.uint8, b, 40 + a), np.frombuffer(data, "<u4", c, 40 + a + b))

    def _low(self, i: int, j: int) -> np.ndarray:
        if not self.width:
            return np.zeros(j - i, np.uint64)
        first = i * self.width
        bits = np.unpackbits(self.lower[first // 8 : (j * self.width + 7) // 8], bitorder="little")[first % 8 :][: (j - i) * self.width]
        return (bits.reshape(-1, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def values(self, i: int = 0, j: int | None = None) -> np.ndarray:
        """The values from i up to, but without, j (int64)."""
        j = self.count if j is None else j
        if not 0 <= i <= j <= self.count:
            raise IndexError(f"{i}:{j} of {self.count}")
        if i == j:
            return np.empty(0, np.int64)
        k = i // SAMPLE
        at = int(self.samples[k])
        last = (j + SAMPLE - 1) // SAMPLE
        stop = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.upper)
        ones = np.flatnonzero(np.unpackbits(self.upper[at // 8 : stop], bitorder="little")[at % 8 :])[i - k * SAMPLE : j - k * SAMPLE] + at
        return (((ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.width)) | self._low(i, j)).astype(np.int64)

    def select(self, i: int) -> int:
        return int(self.values(i, i + 1)[0])


MANIFEST = "part int, path string, documents long, tokens long"


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", slice_rows: int = 512) -> DataFrame:
    """Encodes whole texts and writes shard files in ascending order of the id column.

    Returns the manifest ``(part, path, documents, tokens)`` as a written table, one row per file
    that holds documents; ``part`` orders the files. Every document's ids end with ``end_id``, so a
    null or empty text has one id. Null ids come first; rows with equal ids stand together, ordered
    by a hash of their text. Other columns of the input don't matter, whatever their names. An empty
    input gives an empty manifest.

    A file belongs to one task attempt: its name is new each time, and only files that a finished
    task reported are in the manifest. One shuffle moves the texts to their range.
    """
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if docs.inputFiles() else 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = own.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def write(batches):
        table = library_table(vocabulary)
        fs, root = open_fs(folder)
        part = TaskContext.get().partitionId()
        name = f"{root}/ids-{part:06d}-{uuid.uuid4().hex}.efid"
        out, sizes, names, nulls, kind = None, [], [], 0, "<u4"
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                here = batch.slice(at, slice_rows)
                if out is None:
                    out, kind = fs.open_output_stream(name, compression=None), "<u2" if max(table.top, end_id) < 1 << 16 else "<u4"
                flat, bounds = table.texts(here.column(1).to_pylist())
                sizes.append(np.diff(bounds) + 1)
                known = here.column(0).drop_null()
                nulls += here.num_rows - len(known)
                names.append(known.to_numpy().copy())
                out.write(np.insert(flat, bounds[1:], end_id).astype(kind).tobytes())
        if out is None:
            return
        ends = np.cumsum(np.concatenate([[0], *sizes]))
        known = np.concatenate(names)
        base = int(known[0]) if len(known) else 0
        bounds = EliasFano.of(ends).pack()
        # Differences of longs may need all 64 bits; wrapping around gives them.
        names = EliasFano.of(known.astype(np.uint64) - np.array(base).astype(np.uint64)).pack()
        documents = nulls + len(known)
        footer = json.dumps({"kind": kind, "documents": documents, "tokens": int(ends[-1]), "nulls": nulls, "base": base, "bounds": len(bounds), "names": len(names)}).encode()
        out.write(b"".join([bounds, names, footer, len(footer).to_bytes(4, "little"), MARK]))
        out.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name.rpartition('/')[2]}", "documents": documents, "tokens": int(ends[-1])}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    target = f"{folder}/manifest"
    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(target)
    return spark.read.schema(MANIFEST).parquet(target)


class IdFile:
    """One shard file. ``document(i)`` reads one document by two ``select`` calls; ``documents()``
    streams all of them with a bounded number of ids in memory."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        tail = self.source.read_at(12, size - 12)
        if tail[4:] != MARK:
            raise ValueError(f"{uri} is no id file")
        length = int.from_bytes(tail[:4], "little")
        self.footer = f = json.loads(self.source.read_at(length, size - 12 - length))
        at = size - 12 - length - f["names"]
        self.names = EliasFano.unpack(self.source.read_at(f["names"], at))
        self.bounds = EliasFano.unpack(self.source.read_at(f["bounds"], at - f["bounds"]))
        self.kind = np.dtype(f["kind"])

    def ids(self, first: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.source.read_at((stop - first) * self.kind.itemsize, first * self.kind.itemsize), self.kind).astype("<u4")

    def name(self, i: int) -> int | None:
        return None if i < self.footer["nulls"] else self.names.select(i - self.footer["nulls"]) + self.footer["base"]

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def documents(self, group: int = 1024, window: int = 1 << 20):
        """(document id, start in the file, the ids in pieces of at most ``window``) in file order."""
        n, nulls = self.footer["documents"], self.footer["nulls"]
        for at in range(0, n, group):
            to = min(n, at + group)
            bounds = self.bounds.values(at, to + 1).tolist()
            names = [None] * max(0, min(nulls, to) - at) + (self.names.values(max(at - nulls, 0), max(to - nulls, 0)) + self.footer["base"]).tolist()
            held, low = self.ids(bounds[0], min(bounds[-1], bounds[0] + window)), bounds[0]
            for name, a, b in zip(names, bounds, bounds[1:]):
                if b > low + len(held) and b - a <= window:
                    held, low = self.ids(a, min(bounds[-1], a + window)), a
                if b <= low + len(held):
                    yield name, a, [held[a - low : b - low]]
                else:
                    yield name, a, (self.ids(x, min(b, x + window)) for x in range(a, b, window))


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads the files of a manifest: ``(doc_id, start, n_tokens, ids_crc32)`` per document, and
    ``ids array<int>`` if asked for. ``start`` counts the ids of all documents before it, over all
    files in the order of ``part``. An empty manifest gives an empty table."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("part", "path", F.coalesce(before, F.lit(0)).alias("first"))
    files = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                rows: list[tuple] = []
                for name, start, pieces in IdFile(path).documents():
                    crc, n, kept = 0, 0, []
                    for piece in pieces:
                        crc, n = zlib.crc32(piece, crc), n + len(piece)
                        if with_ids:
                            kept.append(piece)
                    rows.append((name, first + start, n, crc, *([np.concatenate(kept).astype(np.int32)] if with_ids else [])))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))

    return placed.repartition(files).mapInArrow(read, schema)
