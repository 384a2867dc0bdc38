"""Packing by power-of-two decomposition.

A document of n tokens is cut, from its start, into pieces of ``longest`` tokens and then into the
powers of two of what remains, the largest first. Each piece is a sequence of its own in the bucket of
its length: no sequence crosses documents and none holds padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import library_table
from .shared import written


def piece_lengths(n: int, longest: int) -> list[int]:
    """The lengths of the pieces of n tokens, in order. ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, folder: str, vocabulary: str, end_id: int, longest: int = 2048, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, slice_rows: int = 512) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and
    ``ids array<int>`` if asked for.

    A document's tokens are the ids of its whole text and ``end_id``; a null or empty text has that
    one id. ``start`` is the piece's place in its document. ``sequence_id`` counts without gaps
    through the buckets, the longest first; ``offset`` is 0, as a piece fills its sequence. Repeated
    rows are packed each; null ids stay null. Columns other than the two named don't matter. An
    empty table gives no rows.

    Pieces are numbered within their task, the numbers are summed by (task, length) and added: the
    texts are never shuffled.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest is no power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("place", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long" + ", ids array<int>" * with_ids

    def cut(batches):
        table = library_table(vocabulary)
        part, met = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                here = batch.slice(at, slice_rows)
                flat, bounds = table.texts(here.column(1).to_pylist())
                flat = np.insert(flat, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                columns: list[list] = [[] for _ in fields]
                for name, low, high in zip(here.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    start = 0
                    for length in piece_lengths(high - low, longest):
                        piece = flat[low + start : low + start + length]
                        place = met[length] = met.get(length, -1) + 1
                        for column, value in zip(columns, (name, start, length, zlib.crc32(piece), high - low, part, place, piece)):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=pa.schema(fields))

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = written(own.mapInArrow(cut, schema), folder, "pieces")
    counts = written(pieces.groupBy("part", "length").count(), folder, "piece-counts")
    bucket = counts.groupBy("length").agg(F.sum("count").alias("total"))
    bucket = bucket.select("length", F.coalesce(F.sum("total").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    task = counts.select("part", "length", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    first = task.join(bucket, "length").select("part", "length", (F.col("before") + F.col("base")).alias("first"))
    out = pieces.join(first, ["part", "length"])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
