"""WARC archives and their chunked record table.

A payload of any size travels as rows ``(record, chunk, size, digest, last, data)``: ``chunk`` counts
from 0, ``digest`` is the SHA-256 of the payload up to and with this chunk, ``size`` the bytes up to
there. The rows are cut where the payload is read, before any Python worker or shuffle sees it:

1. Each task streams its payloads, chunk by chunk, to a chunk file of its own in the shared folder and
   keeps only the running digest. What it returns is a header row per record.
2. Which records repeat an earlier payload is decided on header rows alone.
3. A task takes the headers of one chunk file, in order, and streams that file's chunks past them into an
   archive. A payload that repeats an earlier record's becomes a revisit, a header that refers to the
   response, and its chunks are passed over.

No payload is shuffled and no step holds more than some chunks. An archive is a sequence of gzip members,
one per record, so a record can be read from its offset.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import open_fs, small_batches, written

CHUNK = 1 << 18
#: The standard's names.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = re.compile(r"<urn:record:(-?\d*)>")

MANIFEST = "part int, path string, records long, bytes long"


class _Member:
    """One gzip member written through to a stream."""

    def __init__(self, out, level: int):
        self.out, self.deflate = out, zlib.compressobj(level, zlib.DEFLATED, 31)

    def write(self, data) -> None:
        self.out.write(self.deflate.compress(data))

    def close(self) -> None:
        self.out.write(self.deflate.flush())


def _head(fields: list[tuple[str, str]]) -> bytes:
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _urn(record_id) -> str:
    return f"<urn:record:{'' if record_id is None else record_id}>"


CHUNKS = pa.schema([("record", pa.int64()), ("chunk", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])
HEADERS = pa.schema([("file", pa.string()), ("record", pa.int64()), ("id", pa.int64()), ("uri", pa.string()), ("size", pa.int64()), ("digest", pa.string())])


def chunk_rows(pages: DataFrame, id_column: str, payload_column: str, uri_column: str | None) -> DataFrame:
    """``id, uri, chunk, chunks, data`` of each payload, its chunks one after another; a null payload is
    one empty chunk. The bytes are taken once, below the generator, and each row copies its own slice."""
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_column).cast("long").alias("id"), (F.col(uri_column).cast("string") if uri_column else F.lit(None).cast("string")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / CHUNK)).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return rows.select("id", "uri", "chunk", "chunks", F.substring("payload", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("data"))


def put_chunks(batches, out):
    """Streams chunk rows to the open IPC file ``out`` and yields ``record, id, uri, size, digest`` after a
    record's last chunk. A batch's rows are written as they come; only the running digest is kept."""
    record, running, size = -1, None, 0
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        ids, uris, data = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)
        done = []
        for i, (chunk, chunks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if chunk == 0:
                record, running, size = record + 1, hashlib.sha256(), 0
            piece = data[i].as_buffer()
            running.update(piece)
            size += len(piece)
            digest, last = running.hexdigest(), chunk == chunks - 1
            for column, value in zip(columns, (record, chunk, size, digest, last)):
                column.append(value)
            if last:
                done.append((record, ids[i], uris[i], size, digest))
        if columns[0]:
            out.write_batch(pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, CHUNKS)), data], schema=CHUNKS))
        yield from done


def write_chunks(pages: DataFrame, folder: str, id_column: str, payload_column: str, uri_column: str | None) -> DataFrame:
    """Writes the chunk files and returns the header rows (HEADERS) as a written table. Each file belongs
    to one task attempt, and only those of finished tasks are named in it."""

    def write(batches):
        fs, root = open_fs(folder)
        name = f"chunks-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
        options = pa.ipc.IpcWriteOptions(compression="lz4")
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out, pa.ipc.new_stream(out, CHUNKS, options=options) as file:
            held = []
            for row in put_chunks(batches, file):
                held.append((name, *row))
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), HEADERS)], schema=HEADERS)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), HEADERS)], schema=HEADERS)

    small_batches(pages.sparkSession)
    rows = chunk_rows(pages, id_column, payload_column, uri_column)
    return written(rows.mapInArrow(write, "file string, record long, id long, uri string, size long, digest string"), folder, "headers")


#: A payload that more than one in so many records share is looked up by broadcast, at most so many.
OFTEN = 1024


def plan_records(headers: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """The header rows with ``refers_to``, the response's id for a revisit.

    Of records with equal payloads of at least ``least`` bytes, those with the least id are responses
    (one, unless rows repeat the id) and the others refer to it; a null id refers to the least id there
    is, and with no other id all are responses. Minima are taken before the shuffle. A digest that more
    than one in OFTEN records share is broadcast, as there are fewer than OFTEN of those; the records that
    have one are dealt out by their place, so that no task gets them all.
    """
    repeats = headers.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    repeats = written(repeats, folder, "repeats")
    often = F.lit(headers.count() / OFTEN)
    hot = repeats.where(F.col("n") > often).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    cold = repeats.where(F.col("n") <= often).select(F.col("digest").alias("of"), "first")
    rows = headers.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    rows = rows.withColumn("by", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat_ws("|", "file", "record")))
    rows = rows.join(cold, F.col("by") == F.col("of"), "left").withColumn("response", F.coalesce("hot_first", "first"))
    revisit = (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("response"))
    return rows.select("file", "record", "id", "uri", "size", "digest", F.when(revisit, F.col("response")).alias("refers_to"))


def get_chunks(source):
    """``record, data`` of each row of an open chunk file, a batch at a time."""
    with pa.ipc.open_stream(source) as file:
        for batch in file:
            data = batch.column("data")
            for i, record in enumerate(batch.column("record").to_pylist()):
                yield record, data[i].as_buffer()


def put_record(out, level: int, date: str, header: tuple, chunks) -> None:
    """Writes one record as a gzip member. ``header`` is (id, uri, size, digest, refers_to)."""
    record, uri, size, digest, refers = header
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _urn(record)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    if uri is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri)))
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers))]
    fields.append(("Content-Length", str(size if refers is None else 0)))
    member = _Member(out, level)
    member.write(_head(fields))
    for data in chunks:
        if refers is None:
            member.write(data)
    member.write(b"\r\n\r\n")
    member.close()


def write_archives(records: DataFrame, folder: str, level: int = 1, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the records of ``plan_records`` as archives, one for each chunk file in ``folder``, and
    returns the manifest ``(part, path, records, bytes)`` as a written table.

    A chunk file's headers go to one task in their order; they are as many as the records of one input
    split. Each archive belongs to one task attempt and only those of finished tasks are in the manifest.
    """

    def write(batches):
        fs, root = open_fs(folder)
        part = TaskContext.get().partitionId()
        done: list[dict] = []
        at = {"file": None, "out": None, "name": "", "records": 0, "source": None, "chunks": None}

        def close():
            if at["out"] is not None:
                size = at["out"].tell()
                at["out"].close()
                at["source"].close()
                done.append({"part": part, "path": f"{folder}/{at['name']}", "records": at["records"], "bytes": size})

        for batch in batches:
            for file, record, *header in zip(*(batch.column(c).to_pylist() for c in ("file", "record", "id", "uri", "size", "digest", "refers_to"))):
                if file != at["file"]:
                    close()
                    source = fs.open_input_stream(f"{root}/{file}", compression=None)
                    name = f"archive-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    at.update(file=file, out=fs.open_output_stream(f"{root}/{name}", compression=None), name=name, records=0, source=source, chunks=groupby(get_chunks(source), itemgetter(0)))
                found, chunks = next(at["chunks"])
                if found != record:
                    raise ValueError(f"chunk file {file}: record {found} stands where {record} is expected")
                put_record(at["out"], level, date, header, (data for _, data in chunks))
                at["records"] += 1
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    target = f"{folder}/archives"
    spark = records.sparkSession
    files = max(1, spark.read.schema(records.schema).parquet(f"{folder}/headers").select("file").distinct().count())
    ordered = records.repartition(files, "file").sortWithinPartitions("file", "record")
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(target)
    return spark.read.schema(MANIFEST).parquet(target)


def write_pages(pages: DataFrame, folder: str, id_column: str = "page_id", payload_column: str = "html", uri_column: str | None = "url") -> DataFrame:
    """The manifest of the archives that hold a record per row of ``pages``."""
    return write_archives(plan_records(write_chunks(pages, folder, id_column, payload_column, uri_column), folder), folder)


class _Inflated:
    """The decompressed bytes of an archive, a buffer at a time."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.raw, self.within = source, zlib.decompressobj(31), bytearray(), b"", False

    def more(self) -> bool:
        """Appends to ``held``; False at the archive's end."""
        while True:
            if self.inflate.eof:
                self.raw, self.inflate, self.within = self.inflate.unused_data, zlib.decompressobj(31), False
            self.raw = self.raw or self.source.read(CHUNK)
            if not self.raw:
                if self.within:
                    raise ValueError("the archive ends within a member")
                return False
            self.within = True
            data = self.inflate.decompress(self.raw, CHUNK)
            self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        head = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return head

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError("the archive ends within a record")
        data = bytes(self.held[:n])
        del self.held[:n]
        return data


def read_records(source):
    """(fields, chunks) of each record of an open archive; the chunks, an iterator of bytes of at most
    CHUNK, must be used up before the next record is asked for."""
    stream = _Inflated(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        left = int(fields["Content-Length"])

        def body(left=left):
            while left:
                data = stream.take(min(left, CHUNK))
                left -= len(data)
                yield data

        yield fields, body()
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record lacks its end")


def read_chunks(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the manifest's archives: ``record_id, record_type, refers_to, uri,
    chunk, size, digest, last`` and, unless left out, ``data``. A revisit is one row, whose size and
    digest are those its header gives for the full payload; a response's are computed from what is
    read, and a digest that differs from the header's is an error. An empty manifest gives no rows.
    """
    kinds = [("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("chunk", pa.int32()), ("size", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())] + [("data", pa.binary())] * with_data
    schema = "record_id long, record_type string, refers_to long, uri string, chunk int, size long, digest string, last boolean" + ", data binary" * with_data
    files = max(1, manifest.count())

    def number(urn: str | None):
        found = RECORD.fullmatch(urn or "")
        return int(found[1]) if found and found[1] else None

    def rows(fields, body):
        name, kind, refers, uri = number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI")
        stated, length = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
        if kind == "revisit":
            yield (name, kind, refers, uri, 0, length, stated, True, *([b""] if with_data else []))
            return
        running, size, k = hashlib.sha256(), 0, 0
        for data in body if length else [b""]:
            running.update(data)
            size += len(data)
            last = size == length
            digest = running.hexdigest()
            if last and digest != stated:
                raise ValueError(f"record {name}: the payload's digest is {digest}, not {stated}")
            yield (name, kind, refers, uri, k, size, digest, last, *([data] if with_data else []))
            k += 1

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                held, weight = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for fields, body in read_records(source):
                        for row in rows(fields, body):
                            held.append(row)
                            weight += 256 + (len(row[-1]) if with_data else 0)
                            if weight >= 4 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), kinds)], schema=pa.schema(kinds))
                                held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), kinds)], schema=pa.schema(kinds))

    return manifest.select("path").repartition(files).mapInArrow(read, schema)


def round_trip(pages: DataFrame, folder: str, id_column: str = "page_id", payload_column: str = "html", uri_column: str | None = "url") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row, from the
    archives: the last chunk of each record. A null payload is empty; null ids stay null; rows that
    repeat an id are records of their own; other columns don't matter; an empty table gives no rows."""
    ends = read_chunks(write_pages(pages, folder, id_column, payload_column, uri_column), with_data=False).where("last")
    return ends.select(F.col("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
