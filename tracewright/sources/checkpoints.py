"""Headers of model checkpoints, read in bounded pieces, and the audit of their router tensors.

A checkpoint has gigabytes of tensor data behind a header of a few megabytes. Files are listed without
their content and each is opened by the task that parses it, through the file system of its URI.
"""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import Refused, refuse_if_any

#: Bytes that are read at a time.
PIECE = 1 << 20
#: The mark, scalar widths of header values by type number (8 is a string, 9 an array), and
#: the names of tensor types by number.
MAGIC, STRING, ARRAY = b"GGUF", 8, 9
WIDTH = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
TYPES = {0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 6: "Q5_0", 7: "Q5_1", 8: "Q8_0", 9: "Q8_1", 10: "Q2_K", 11: "Q3_K", 12: "Q4_K", 13: "Q5_K", 14: "Q6_K", 15: "Q8_K", 24: "I8", 25: "I16", 26: "I32", 27: "I64", 28: "F64", 30: "BF16"}
#: Ends of router tensors' names, and the types in which a router keeps its ranking.
ROUTERS, ACCEPTED = (".ffn_gate_inp.weight", ".ffn_gate_inp_shexp.weight"), ("F32", "F16", "BF16")


class _Reader:
    """Numbers and texts from an open file, PIECE bytes at a time; skipped bytes are never read."""

    def __init__(self, source):
        self.source, self.held, self.at = source, b"", 0

    def bytes(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = self.source.read(max(PIECE, n))
            if not more:
                raise Refused("the file ends within its header")
            self.held, self.at = self.held[self.at :] + more, 0
        self.at += n
        return self.held[self.at - n : self.at]

    def skip(self, n: int) -> None:
        inside = min(n, len(self.held) - self.at)
        self.at += inside
        if n > inside:
            self.held, self.at = b"", 0
            self.source.seek(self.source.tell() + n - inside)

    def number(self, form: str) -> int:
        return struct.unpack("<" + form, self.bytes(struct.calcsize(form)))[0]

    def text(self) -> str:
        return self.bytes(self.number("Q")).decode()

    def pass_value(self, kind: int) -> None:
        if kind == STRING:
            self.skip(self.number("Q"))
        elif kind != ARRAY:
            self.skip(WIDTH[kind])
        else:
            inner, n = self.number("I"), self.number("Q")
            if inner == ARRAY:
                raise Refused("an array of arrays")
            if inner == STRING:
                for _ in range(n):
                    self.skip(self.number("Q"))
            else:
                self.skip(WIDTH[inner] * n)


def header_tensors(source) -> list[tuple[str, list[int], int, int]]:
    """(name, dims, type, offset) of the tensors of a version-3 header; no tensor data is looked at."""
    r = _Reader(source)
    if r.bytes(4) != MAGIC:
        raise Refused("no such header")
    if (version := r.number("I")) != 3:
        raise Refused(f"header version {version}")
    tensors, pairs = r.number("Q"), r.number("Q")
    for _ in range(pairs):
        r.skip(r.number("Q"))
        r.pass_value(r.number("I"))
    out = []
    for _ in range(tensors):
        name, n = r.text(), r.number("I")
        if n > 4:
            raise Refused(f"{name} has {n} dimensions")
        out.append((name, [r.number("Q") for _ in range(n)], r.number("I"), r.number("Q")))
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files below a path; their content is not read."""
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    return found.repartition(max(1, min(1000, found.count())))


def _opened(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return system.open_input_file(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, dims, type, offset`` for each tensor of the checkpoint files below a path."""

    def parse(batches):
        for batch in batches:
            for p in batch["path"]:
                with _opened(p) as source:
                    yield pd.DataFrame([(p, *t) for t in header_tensors(source)], columns=["path", "name", "dims", "type", "offset"])

    return _files(spark, path).mapInPandas(parse, "path string, name string, dims array<long>, type int, offset long")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files, a piece at a time."""

    def digest(batches):
        for batch in batches:
            for p, n in zip(batch["path"], batch["length"]):
                running = hashlib.sha256()
                with _opened(p) as source:
                    while piece := source.read(PIECE):
                        running.update(piece)
                yield pd.DataFrame([(p, n, running.hexdigest())], columns=["path", "length", "sha256"])

    return _files(spark, path).mapInPandas(digest, "path string, length long, sha256 string")


def routers(tensors: DataFrame) -> DataFrame:
    """``path, name, dims, type_name, n_elements, accepted`` of the router tensors of ``read_headers``."""
    named = F.lit(False)
    for end in ROUTERS:
        named = named | F.col("name").endswith(end)
    type_name = F.coalesce(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("type")], F.concat(F.lit("type "), F.col("type").cast("string")))
    elements = F.aggregate("dims", F.lit(1).cast("long"), lambda a, b: a * b)
    return tensors.where(named).select("path", "name", "dims", type_name.alias("type_name"), elements.alias("n_elements")).withColumn("accepted", F.col("type_name").isin(*ACCEPTED))


def router_types(tensors: DataFrame) -> DataFrame:
    """``path, type_name, n``: how many router tensors of a checkpoint have each type."""
    return routers(tensors).groupBy("path", "type_name").agg(F.count("*").alias("n"))


def router_gate(tensors: DataFrame) -> DataFrame:
    """``path, n_tensors, n_routers, n_refused, passed`` per checkpoint: whether every router tensor has an
    accepted type. A checkpoint without any router tensor is refused, as nothing was checked then."""
    all_ = tensors.groupBy("path").agg(F.count("*").alias("n_tensors"))
    found = routers(tensors).groupBy("path").agg(F.count("*").alias("n_routers"), F.count_if(~F.col("accepted")).alias("n_refused"))
    out = all_.join(found, "path", "left")
    refuse_if_any(out.where("n_routers IS NULL"), "no router tensor")
    return out.withColumn("passed", F.col("n_refused") == 0)
