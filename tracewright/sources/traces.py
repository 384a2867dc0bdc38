"""The binary trace layout as a Spark data source, a writer of shards, and one of synthetic traces.

A shard is a folder ``root/model/corpus/shard_NNNNN`` with a manifest and fixed-stride streams,
layer-major within a token. ``spark.read.format("trace").option("stream", ...)`` gives one stream as a
table; each shard is cut in parts of ``rows`` tokens, so a part is a task with a bounded buffer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.checks import Refused
from ..operators.tables import kept
from ..operators.validation import INVARIANT

#: Files, element types and the token record of the layout.
FILES = {"tokens": "tokens.bin", "topk": "topk.bin", "logits": "logits.bin", "hidden": "hidden.bin", "hidden_index": "hidden_index.bin"}
RECORD = np.dtype([("token_id", "<u4"), ("doc_id", "<u4"), ("pos_in_doc", "<u4"), ("flags", "<u4")])
CAPTURED = 1
MANIFEST = "manifest.json"

SCHEMAS = {
    "tokens": "model string, corpus string, shard_id int, row_id long, token_id long, doc_id long, pos_in_doc int, hidden_captured boolean",
    "topk": "model string, corpus string, shard_id int, row_id long, layer int, experts array<int>",
    "logits": "model string, corpus string, shard_id int, row_id long, layer int, scores array<float>",
    "hidden": "model string, corpus string, shard_id int, index long, layer int, hidden array<float>",
}
_TYPES = {"tokens": [pa.int64(), pa.int64(), pa.int32(), pa.bool_()], "topk": [pa.int32(), pa.list_(pa.int32())], "logits": [pa.int32(), pa.list_(pa.float32())], "hidden": [pa.int32(), pa.list_(pa.float32())]}


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def strides(manifest: dict) -> dict[str, int]:
    """Bytes of each stream per token, or per captured token for the hidden ones."""
    layers = manifest["n_moe_layers"]
    return {"tokens": RECORD.itemsize, "topk": layers * manifest["top_k"] * 4, "logits": layers * manifest["n_experts"] * 2, "hidden": layers * manifest["hidden_dim"] * 2, "hidden_index": 4}


def shards(uri: str, validate_sizes: bool = True) -> list[tuple[str, dict]]:
    """(path, manifest) of all shards below a root, in order. Shards of one (model, corpus) must agree in
    the merge-invariant fields; streams must have the sizes their manifests say."""
    from pyarrow import fs as pafs

    fs, root = _fs(uri)
    out = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda i: i.path):
        if info.base_name == MANIFEST:
            folder = info.path.rpartition("/")[0]
            with fs.open_input_stream(info.path, compression=None) as f:
                manifest = json.loads(f.read())
            if not 0 < manifest["top_k"] <= manifest["n_experts"] or min(manifest["n_moe_layers"], manifest["hidden_dim"]) <= 0:
                raise Refused(f"{folder}: impossible geometry")
            if validate_sizes:
                for stream, each in strides(manifest).items():
                    rows = manifest["n_captured"] if stream.startswith("hidden") else manifest["n_tokens"]
                    size = fs.get_file_info(f"{folder}/{FILES[stream]}").size
                    if size != rows * each:
                        raise Refused(f"{folder}/{FILES[stream]} has {size} bytes, not {rows} x {each}")
            out.append((folder, manifest))
    seen: dict[tuple, dict] = {}
    for folder, m in out:
        first = seen.setdefault((m["model"], m["corpus"]), m)
        for key in (*INVARIANT, "n_moe_layers", "top_k", "hidden_dim"):
            if m.get(key) != first.get(key):
                raise Refused(f"{folder}: {key} is {m.get(key)!r}, elsewhere {first.get(key)!r}")
    return out


class _Part(InputPartition):
    def __init__(self, folder: str, manifest: dict, first: int, start: int, stop: int):
        self.folder, self.manifest, self.first, self.start, self.stop = folder, manifest, first, start, stop


class TraceReader(DataSourceReader):
    def __init__(self, options, stream: str):
        self.uri, self.stream, self.rows = options["path"], stream, int(options.get("rows", 50_000))
        self.validate = options.get("validate_sizes", "true").lower() == "true"

    def partitions(self):
        parts, before = [], {}
        for folder, m in shards(self.uri, self.validate):
            key = (m["model"], m["corpus"])
            first = before.get(key, 0)
            n = m["n_captured"] if self.stream == "hidden" else m["n_tokens"]
            parts += [_Part(folder, m, first, at, min(n, at + self.rows)) for at in range(0, n, self.rows)]
            before[key] = first + m["n_tokens"]
        return parts

    def _read(self, fs, part: _Part, stream: str, kind, shape) -> np.ndarray:
        each = strides(part.manifest)[stream]
        with fs.open_input_file(f"{part.folder}/{FILES[stream]}") as f:
            data = f.read_at((part.stop - part.start) * each, part.start * each)
        return np.frombuffer(data, kind).reshape(part.stop - part.start, *shape)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.uri)
        m, n = part.manifest, part.stop - part.start
        row = part.first + np.arange(part.start, part.stop)
        if self.stream == "tokens":
            r = self._read(fs, part, "tokens", RECORD, ())
            columns = [row, r["token_id"].astype(np.int64), r["doc_id"].astype(np.int64), r["pos_in_doc"].astype(np.int32), (r["flags"] & CAPTURED).astype(bool)]
        else:
            layers = m["n_moe_layers"]
            width, kind, out = {"topk": (m["top_k"], "<i4", np.int32), "logits": (m["n_experts"], "<f2", np.float32), "hidden": (m["hidden_dim"], "<f2", np.float32)}[self.stream]
            if self.stream == "hidden":
                row = self._read(fs, part, "hidden_index", "<u4", ()).astype(np.int64)
            values = self._read(fs, part, self.stream, kind, (layers, width)).astype(out)
            lists = pa.ListArray.from_arrays(np.arange(0, n * layers * width + 1, width, dtype=np.int32), pa.array(values.ravel()))
            columns = [np.repeat(row, layers), np.tile(np.arange(layers, dtype=np.int32), n), lists]
        size = len(columns[0])
        same = [pa.array([v] * size, t) for v, t in ((m["model"], pa.string()), (m["corpus"], pa.string()), (m["shard_id"], pa.int32()))]
        arrays = same + [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, [pa.int64(), *_TYPES[self.stream]])]
        names = [f.split()[0] for f in SCHEMAS[self.stream].split(", ")]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


class TraceSource(DataSource):
    """``format("trace")`` with the options ``path`` (a URI), ``stream``, ``rows`` and ``validate_sizes``."""

    @classmethod
    def name(cls):
        return "trace"

    def schema(self):
        return SCHEMAS[self.options.get("stream", "tokens")]

    def reader(self, schema):
        return TraceReader(self.options, self.options.get("stream", "tokens"))


def read(spark: SparkSession, uri: str, stream: str = "tokens", **options) -> DataFrame:
    """A stream of all shards below a root URI."""
    spark.dataSource.register(TraceSource)
    return spark.read.format("trace").options(path=uri, stream=stream, **{k: str(v) for k, v in options.items()}).load()


class _Shard:
    """The streams of one shard, written below a folder of this attempt and moved in place when whole."""

    def __init__(self, uri: str, key: tuple, shape: Mapping):
        self.fs, self.root = _fs(uri)
        self.key, self.shape = key, shape
        self.attempt = f"{self.root}/_attempts/{uuid.uuid4().hex}"
        self.fs.create_dir(self.attempt, recursive=True)
        self.out = {name: self.fs.open_output_stream(f"{self.attempt}/{file}", compression=None) for name, file in FILES.items()}
        self.n_tokens = self.n_captured = 0
        self.last = (-1, -1)

    def append(self, doc: np.ndarray, pos: np.ndarray, token: np.ndarray, taken: np.ndarray, values: Mapping[str, np.ndarray]) -> None:
        """Whole tokens, in order of document and place."""
        before = np.concatenate([[self.last], np.stack([doc, pos], axis=1)[:-1]])
        gaps = pos != np.where(doc == before[:, 0], before[:, 1] + 1, 0)
        if gaps.any():
            raise Refused(f"{self.key}: document {doc[gaps][0]} has a gap or a repeated token before place {pos[gaps][0]}")
        records = np.zeros(len(doc), RECORD)
        index = doc[taken] * self.shape["index_doc_span"] + pos[taken]
        for name, column in (("token_id", token), ("doc_id", doc), ("pos_in_doc", pos)):
            records[name] = _unsigned(column, f"{self.key}: {name}")
        records["flags"] = taken * CAPTURED
        for name, data in {"tokens": records, "hidden_index": _unsigned(index, f"{self.key}: hidden index"), **values}.items():
            self.out[name].write(np.ascontiguousarray(data).tobytes())
        self.n_tokens, self.n_captured, self.last = self.n_tokens + len(doc), self.n_captured + len(index), (doc[-1], pos[-1])

    def close(self) -> tuple:
        """Moves the streams in place; the manifest comes last, so that a shard is seen whole or not at all."""
        model, corpus, shard = self.key
        folder = f"{self.root}/{model}/{corpus}/shard_{shard:05d}"
        manifest = {"model": model, "corpus": corpus, "shard_id": shard, "n_tokens": self.n_tokens, "n_captured": self.n_captured, **self.shape}
        for stream in self.out.values():
            stream.close()
        self.fs.create_dir(folder, recursive=True)
        if self.fs.get_file_info(f"{folder}/{MANIFEST}").is_file:
            self.fs.delete_file(f"{folder}/{MANIFEST}")
        for name, each in strides(manifest).items():
            rows = self.n_captured if name.startswith("hidden") else self.n_tokens
            size = self.fs.get_file_info(f"{self.attempt}/{FILES[name]}").size
            if size != rows * each:
                raise Refused(f"{folder}: {FILES[name]} has {size} bytes, not {rows} x {each}")
            self.fs.move(f"{self.attempt}/{FILES[name]}", f"{folder}/{FILES[name]}")
        with self.fs.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(manifest).encode())
        self.fs.delete_dir(self.attempt)
        return (model, corpus, shard, self.n_tokens, self.n_captured)


def _unsigned(values: np.ndarray, what: str) -> np.ndarray:
    if len(values) and not 0 <= values.min() <= values.max() < 1 << 32:
        raise Refused(f"{what} does not fit 32 bits")
    return values.astype("<u4")


def _lists(column: pa.Array, width: int, kind: str, what: str) -> np.ndarray:
    """Rows of equal width as an array; a null, another width or a value beyond the element type is refused."""
    flat = pc.list_flatten(column)
    if column.null_count or flat.null_count or (len(column) and pc.any(pc.not_equal(pc.list_value_length(column), width)).as_py()):
        raise Refused(f"{what}: a row without {width} values")
    values = flat.to_numpy(zero_copy_only=False).reshape(len(column), width)
    with np.errstate(over="ignore"):
        out = values.astype(kind)
    if np.any(np.isinf(out) & np.isfinite(values)):
        raise Refused(f"{what}: a value beyond half precision")
    return out


def write(rows: DataFrame, uri: str, shape: Mapping) -> DataFrame:
    """Shards of a trace from ``rows(model, corpus, shard_id, doc_id, pos, token_id, layer, experts, scores,
    hidden)``, one row per token and layer in any order; returns ``model, corpus, shard_id, n_tokens, n_captured``.

    ``shape`` holds what every manifest of the run says: n_moe_layers, n_experts, top_k, hidden_dim,
    index_doc_span and the merge-invariant fields. A token that was captured has ``hidden`` at every layer, another
    at none. A shard is a task that sorts its rows by document, place and layer and streams them into the
    files, so the shards should be cut to a bounded number of tokens first. A shard that is written again
    replaces the former one. Other columns are passed over; an empty table writes nothing. A null, a token
    without every layer once, a gap in a document and vectors of another width are refused.
    """
    layers = shape["n_moe_layers"]
    key, order = ["model", "corpus", "shard_id"], ["doc_id", "pos", "layer"]
    widths = {"topk": ("experts", shape["top_k"], "<i4"), "logits": ("scores", shape["n_experts"], "<f2"), "hidden": ("hidden", shape["hidden_dim"], "<f2")}
    plain = ["model", "corpus", "cast(shard_id as int) shard_id", "cast(doc_id as long) doc_id", "cast(pos as long) pos", "cast(token_id as long) token_id", "cast(layer as int) layer"]
    dealt = rows.selectExpr(*plain, "cast(experts as array<int>) experts", "cast(scores as array<float>) scores", "cast(hidden as array<float>) hidden")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, *order)

    def tokens(shard: _Shard, t: pa.Table) -> None:
        number = {c: t[c].to_numpy().reshape(-1, layers) for c in ("doc_id", "pos", "token_id", "layer")}
        whole = (number["layer"] == np.arange(layers)).all() and all((number[c] == number[c][:, :1]).all() for c in ("doc_id", "pos", "token_id"))
        captured = t["hidden"].is_valid().to_numpy().reshape(-1, layers)
        if not whole or (captured != captured[:, :1]).any():
            raise Refused(f"{shard.key}: a token lacks a layer, repeats one, or was captured in part")
        values = {}
        for name, (column, width, kind) in widths.items():
            data = t[column].drop_null() if name == "hidden" else t[column]
            values[name] = _lists(data.combine_chunks(), width, kind, f"{shard.key}: {column}")
        shard.append(*(number[c][:, 0] for c in ("doc_id", "pos", "token_id")), captured[:, 0], values)

    def runs(t: pa.Table) -> Iterator[tuple[tuple, pa.Table]]:
        if any(t[c].null_count for c in (*key, "doc_id", "pos", "token_id", "layer")):
            raise Refused("a row of the trace has a null in its key")
        starts = np.zeros(t.num_rows, bool)
        starts[0] = True
        for c in key:
            starts[1:] |= pc.not_equal(t[c][1:], t[c][:-1]).to_numpy()
        cuts = [*np.flatnonzero(starts).tolist(), t.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(t[c][a].as_py() for c in key), t.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rest, done = None, None, []

        def finished() -> None:
            if rest is not None and rest.num_rows:
                raise Refused(f"{shard.key}: the last token lacks a layer")
            done.append(shard.close())

        for batch in batches:
            if not batch.num_rows:
                continue
            for name, t in runs(pa.Table.from_batches([batch])):
                if shard is None or shard.key != name:
                    if shard is not None:
                        finished()
                    shard, rest = _Shard(uri, name, shape), None
                t = t if rest is None else pa.concat_tables([rest, t])
                full = t.num_rows // layers * layers
                if full:
                    tokens(shard, t.slice(0, full))
                rest = t.slice(full)
        if shard is not None:
            finished()
        yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())))))

    names = (*key, "n_tokens", "n_captured")
    return kept(dealt.mapInArrow(run, "model string, corpus string, shard_id int, n_tokens long, n_captured long"))


def synthetic(uri: str, sizes: list[int], n_layers: int = 4, n_experts: int = 16, top_k: int = 3, hidden_dim: int = 8, tokens_per_doc: int = 10, span: int = 64, stride: int = 4, seed: int = 0, route: Callable | None = None, model: str = "synth", corpus: str = "main", overrides: dict[int, dict] | None = None) -> None:
    """Writes shards of the given token counts. ``route(token_id, layer)`` plants the ranking of experts;
    by default it is random. Scores are a falling sequence along the ranking, in half precision; the
    hidden subsample is every ``stride``-th of ``doc_id * span + pos``."""
    fs, root = _fs(uri)
    rng, done = np.random.default_rng(seed), 0
    for shard, n in enumerate(sizes):
        at = done + np.arange(n)
        doc, pos = at // tokens_per_doc, at % tokens_per_doc
        taken = (doc * span + pos) % stride == 0 if stride else np.zeros(n, bool)
        records = np.zeros(n, RECORD)
        records["token_id"], records["doc_id"], records["pos_in_doc"], records["flags"] = rng.integers(0, 40, n), doc, pos, taken * CAPTURED
        rank = np.array([[route(int(t), layer) if route else rng.permutation(n_experts) for layer in range(n_layers)] for t in records["token_id"]]).reshape(n, n_layers, n_experts)
        scores = np.empty((n, n_layers, n_experts), "<f2")
        np.put_along_axis(scores, rank, np.broadcast_to(np.linspace(1, 0, n_experts).astype("<f2"), rank.shape), axis=2)
        hidden = rng.standard_normal((int(taken.sum()), n_layers, hidden_dim)).astype("<f2")
        manifest = {"model": model, "corpus": corpus, "shard_id": shard, "n_tokens": n, "n_captured": int(taken.sum()), "n_moe_layers": n_layers, "n_experts": n_experts, "top_k": top_k, "hidden_dim": hidden_dim, "run_config_sha256": "0" * 64, "logit_tensor_used": "scores", "hidden_stride": stride, "index_doc_span": span}
        folder = f"{root}/{model}/{corpus}/shard_{shard:05d}"
        fs.create_dir(folder, recursive=True)
        streams = {"tokens": records, "topk": rank[:, :, :top_k].astype("<i4"), "logits": scores, "hidden": hidden, "hidden_index": (doc * span + pos)[taken].astype("<u4")}
        for name, data in streams.items():
            with fs.open_output_stream(f"{folder}/{FILES[name]}", compression=None) as f:
                f.write(np.ascontiguousarray(data).tobytes())
        with fs.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(manifest | (overrides or {}).get(shard, {})).encode())
        done += n
