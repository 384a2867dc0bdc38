"""Checkpoints, logs, results, configurations, and checks of what a capture left behind."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tracewright.operators import ledger, reports, sweep, validation
from tracewright.operators.checks import Refused
from tracewright.sources import checkpoints, documents


def checkpoint(path, tensors, size=0):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    data = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), 3)
    data += text("name") + struct.pack("<I", 8) + text("x" * 3000) + text("ids") + struct.pack("<IIQ", 9, 4, 700_000) + b"\0" * 2_800_000
    data += text("words") + struct.pack("<IIQ", 9, 8, 5) + b"".join(text(f"w{i}") for i in range(5))
    for i, (name, kind) in enumerate(tensors):
        data += text(name) + struct.pack("<IQQIQ", 2, 8, 16, kind, 64 * i)
    with open(path, "wb") as f:
        f.write(data)
        f.truncate(max(size, len(data)))


def test_header_of_a_file_past_two_gigabytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checkpoints, "PIECE", 4096)
    checkpoint(tmp_path / "m.gguf", [("blk.0.ffn_gate_inp.weight", 0), ("blk.0.up.weight", 12)], size=3 << 30)
    found = checkpoints.read_headers(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [(r.name, list(r.dims), r.type, r.offset) for r in found] == [("blk.0.ffn_gate_inp.weight", [8, 16], 0, 0), ("blk.0.up.weight", [8, 16], 12, 64)]


def test_header_that_ends_early_is_refused(tmp_path):
    checkpoint(tmp_path / "m.gguf", [("blk.0.ffn_gate_inp.weight", 0)])
    (tmp_path / "cut").write_bytes((tmp_path / "m.gguf").read_bytes()[:-10])
    with open(tmp_path / "cut", "rb") as f, pytest.raises(Refused):
        checkpoints.header_tensors(f)


def test_router_gate(spark, tmp_path):
    (tmp_path / "a").mkdir()
    checkpoint(tmp_path / "a/good.gguf", [("blk.0.ffn_gate_inp.weight", 0), ("blk.1.ffn_gate_inp.weight", 30), ("blk.1.up.weight", 12)])
    checkpoint(tmp_path / "a/bad.gguf", [("blk.0.ffn_gate_inp.weight", 0), ("blk.1.ffn_gate_inp.weight", 12)])
    tensors = checkpoints.read_headers(spark, f"file://{tmp_path}/a")
    gate = {r.path.rsplit("/", 1)[1]: (r.n_tensors, r.n_routers, r.n_refused, r.passed) for r in checkpoints.router_gate(tensors).collect()}
    assert gate == {"good.gguf": (3, 2, 0, True), "bad.gguf": (2, 2, 1, False)}
    assert {(r.path.rsplit("/", 1)[1], r.type_name, r.n) for r in checkpoints.router_types(tensors).collect()} == {("good.gguf", "F32", 1), ("good.gguf", "BF16", 1), ("bad.gguf", "F32", 1), ("bad.gguf", "Q4_K", 1)}
    checkpoint(tmp_path / "a/dense.gguf", [("blk.0.up.weight", 0)])
    with pytest.raises(Refused):
        checkpoints.router_gate(checkpoints.read_headers(spark, f"file://{tmp_path}/a"))


SHAPE = {"n_tokens": 40, "n_moe_layers": 4, "n_experts": 16, "top_k": 3, "hidden_dim": 8, "n_captured": 10}
CLEAN = SHAPE | {"exit_code": 0, "topk_layout": "strided", "n_docs_truncated": 0, "n_tokens_dropped": 0, "first_truncated_doc": None, "nodes_captured": 24}


@pytest.mark.parametrize(
    "change, expect",
    [({}, []), ({"exit_code": 137}, ["error"]), ({"n_docs_truncated": 2, "n_tokens_dropped": 51, "first_truncated_doc": 7}, ["error"]), ({"topk_layout": "mixed"}, ["error"]), ({"topk_layout": None}, ["warning"]), ({"nodes_captured": 25}, ["warning"]), ({"n_captured": 9}, ["error"]), ({"hidden_dim": 9, "top_k": 2}, ["error", "error"])],
)
def test_capture_statistics(spark, change, expect):
    manifests = spark.createDataFrame([{"shard_id": k} | SHAPE for k in (0, 1)])
    kinds = "shard_id long, n_tokens long, n_moe_layers long, n_experts long, top_k long, hidden_dim long, n_captured long, exit_code long, topk_layout string, n_docs_truncated long, n_tokens_dropped long, first_truncated_doc long, nodes_captured long"
    stats = spark.createDataFrame([{"shard_id": 0} | CLEAN | change], kinds)
    found = validation.capture_stats(manifests, stats).collect()
    assert [r.severity for r in found if r.shard_id == 0] == expect and [r.severity for r in found if r.shard_id == 1] == ["warning"]


def test_hidden_rows_are_compared_one_by_one(spark):
    tokens = [(d, p, (d * 64 + p) % 4 == 0) for d in range(3) for p in range(10)]
    index = [(d * 64 + p,) for d, p, c in tokens if c]
    frames = lambda t, i: (spark.createDataFrame(t, "doc_id long, pos int, captured boolean"), spark.createDataFrame(i, "value long"))
    assert validation.hidden_rows(*frames(tokens, index), 64, 4).collect() == []
    tokens[1] = (0, 1, True)
    tokens[8] = (0, 8, False)
    found = {r.kind: (r.n, r.first_index) for r in validation.hidden_rows(*frames(tokens, [*index[1:], (5,), (64,)]), 64, 4).collect()}
    assert found == {"missing": (1, 0), "extra": (1, 5), "unflagged": (1, 8), "flagged": (1, 1), "repeated": (1, 64)}


def test_strict_lookup_and_captured_rows(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "doc_id long, pos int, layer int")
    hidden = spark.createDataFrame([(0, 0, 0, [1.0])], "doc_id long, pos int, layer int, hidden array<double>")
    assert [r.pos for r in validation.captured(rows, hidden).collect()] == [0]
    assert validation.with_hidden(rows.where("pos = 0"), hidden).first()["hidden"] == [1.0]
    for bad, vectors in ((rows, hidden), (rows.where("pos = 0"), hidden.union(hidden))):
        with pytest.raises(Refused):
            validation.with_hidden(bad, vectors)


def test_first_tokens(spark, monkeypatch):
    monkeypatch.setattr(validation, "SPAN", 4)
    rows = spark.createDataFrame([(s, r) for s in (0, 1, 2) for r in range(10)], "shard_id int, row_id long").repartition(3)
    assert sorted(map(tuple, validation.first_tokens(rows, 13).collect())) == [(0, r) for r in range(10)] + [(1, r) for r in range(3)]


def test_framing_goes_with_every_row_and_totals(spark):
    pairs = spark.createDataFrame([("F1", 0.1, 0.2)], "feature string, a double, b double")
    row = reports.framed(pairs, "A", ["k"], [], "size differs").first()
    assert (row.pair, row.feature, row.holds_fixed, row.not_matched, row.framing) == ("A", "F1", ["k"], [], "size differs")
    with pytest.raises(Refused):
        reports.framed(pairs, "A", ["k"], [], " ")
    log = spark.createDataFrame([(0, "done", 10), (1, "failed", 5), (2, "done", 7)], "shard_id int, status string, n_tokens long")
    assert tuple(ledger.totals(log).first()) == (17, 2) and tuple(ledger.totals(log.limit(0)).first()) == (0, 0)


def test_sweep_goes_on_where_it_stopped(spark, tmp_path):
    folder = f"file://{tmp_path}/results"
    model = {"model": "m", "run_config_sha256": "c", "logit_tensor_used": "t", "n_moe_layers": 2, "n_experts": 8, "top_k": 2}
    rows = spark.createDataFrame([(1, 50, 0.5, 0.75, 0.25, 3.0, 2.0, 1.0)], "layer int, n_rows long, set_agreement double, recall_2k double, exact_match double, entropy_bits double, cross_entropy_bits double, mi_bits double")
    made = []

    def feature(name):
        return lambda: (made.append(name), rows)[1]

    assert sweep.sweep(spark, folder, model, {"F2": feature("F2")}, {"F2": {0: "no layer below"}}) == ["F2"]
    assert sweep.sweep(spark, folder, model, {"F2": feature("F2"), "F3": feature("F3")}) == ["F3"] and made == ["F2", "F3"]
    cells = documents.read_results(spark, folder).orderBy("feature", "layer").collect()
    assert [(c.feature, c.layer, c.status, c.reason) for c in cells] == [("F2", 0, "skipped", "no layer below"), ("F2", 1, "ok", None), ("F3", 0, "skipped", "no rows"), ("F3", 1, "ok", None)]
    assert cells[1].metrics.family_b["mi_bits"] == 1.0 and cells[1].metrics.family_a["recall@4"] == 0.75 and cells[1].metrics.n_slots == 100
    with pytest.raises(Refused):
        sweep.sweep(spark, folder, model | {"run_config_sha256": "d"}, {"F2": feature("F2")})
    documents.write_result(spark, folder, {"model": "m", "feature": "F2", "layers": {}} | model)
    assert len(list((tmp_path / "results").glob("*.json"))) == 2 and not list((tmp_path / "results").glob("*.part"))


def test_logs_are_appended_and_keep_their_columns(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for k in range(2):
        documents.append_log(spark.createDataFrame([(k, "done, \"so\"")], "shard_id int, note string"), path)
    assert sorted(map(tuple, documents.read_log(spark, path, "shard_id int, note string").collect())) == [(0, 'done, "so"'), (1, 'done, "so"')]
    with pytest.raises(Refused):
        documents.append_log(spark.createDataFrame([(1,)], "other int"), path)


def test_configurations(spark, tmp_path):
    config = {"models": {"m": {"n_moe_layers": 2, "n_experts": 8, "top_k": 2, "aux_loss": 0.01}, "a": {"n_moe_layers": 1, "n_experts": 4, "top_k": 1}}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert documents.read_config(spark, f"file://{tmp_path}/c.json") == config
    assert [tuple(r) for r in documents.model_rows(spark, config).collect()] == [("a", 1, 4, 1, None), ("m", 2, 8, 2, 0.01)]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    assert documents.read_config(spark, f"file://{tmp_path}/c.yaml") == config
    (tmp_path / "l.yaml").write_text("- 1\n- 2\n")
    with pytest.raises(Refused):
        documents.read_config(spark, f"file://{tmp_path}/l.yaml")
    with pytest.raises(Refused):
        documents.model_rows(spark, {"models": {"m": {"n_experts": 8}}})


def test_digests_templates_and_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([("é", "ffn-%d", 3), (None, "none", 3), ("", "%d-%d", 3)], "text string, template string, n int")
    found = rows.select(documents.blake2b(F.col("text")).alias("h"), documents.blake2b(F.col("text"), 128).alias("g"), documents.expanded(F.col("template"), F.col("n")).alias("name")).collect()
    assert [r.h for r in found] == [hashlib.blake2b("é".encode(), digest_size=8).hexdigest(), None, hashlib.blake2b(b"", digest_size=8).hexdigest()]
    assert len(found[0].g) == 32 and [r.name for r in found] == ["ffn-3", None, None]
    docs = spark.createDataFrame([(i, f"t{i}", "prose", "en", "s", 5, "train" if i else "test", i % 2) for i in range(4)], documents.CORPUS)
    sums = []
    for k, frame in enumerate((docs, docs.orderBy(F.desc("doc_id")).repartition(3))):
        documents.write_sidecar(spark, frame, f"file://{tmp_path}/side{k}")
        sums.append(json.loads(spark.read.text(f"file://{tmp_path}/side{k}").first()["value"]))
    assert sums[0] == sums[1] and sums[0]["n_docs"] == 4 and sums[0]["tokens_by_split"] == {"test": 5, "train": 15}


def test_layers_without_any_node_are_reported(spark):
    nodes = spark.createDataFrame([("a", 0)], "base string, il int")
    assert {(r.il, r.base, r.n) for r in documents.node_counts(nodes, ["a"], 2).collect()} == {(0, "a", 1), (1, "a", 0)}
