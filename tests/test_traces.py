import json
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import checks, drift, probes, reports, tables, validation
from tracewright.plans import probe_queries
from tracewright.plans.views import frame
from tracewright.sources import checkpoints, documents, traces
from tracewright.streaming import ingest


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    uri = f"file://{tmp_path_factory.mktemp('trace')}"
    traces.synthetic(uri, [40, 25, 35])
    return uri


def test_round_trip_across_shards(spark, root):
    tokens = traces.read(spark, root, "tokens", rows=16).orderBy("row_id").collect()
    assert [t.row_id for t in tokens] == list(range(100)) and [t.doc_id for t in tokens] == [i // 10 for i in range(100)]
    topk = traces.read(spark, root, "topk", rows=7)
    logits = traces.read(spark, root, "logits", rows=9)
    assert topk.count() == logits.count() == 400
    both = topk.join(logits, ["row_id", "layer"]).withColumnRenamed("scores", "s")
    rows = both.select(F.col("row_id").alias("token"), F.transform("s", lambda x: x.cast("double")).alias("scores"), F.col("experts").alias("truth"))
    r = validation.argsort_agreement(rows, 3).first()
    assert r.agree == r.n == 400
    hidden = traces.read(spark, root, "hidden", rows=3)
    flagged = {t.doc_id * 64 + t.pos_in_doc for t in tokens if t.hidden_captured}
    assert {h["index"] for h in hidden.collect()} == flagged and all(len(h.hidden) == 8 for h in hidden.collect())


SHAPE = {"n_moe_layers": 4, "n_experts": 16, "top_k": 3, "hidden_dim": 8, "index_doc_span": 64, "hidden_stride": 4, "run_config_sha256": "0" * 64, "logit_tensor_used": "scores"}


def trace_rows(spark, uri):
    """What ``write`` takes, joined from the streams of a trace."""
    t = traces.read(spark, uri, "tokens").withColumnRenamed("pos_in_doc", "pos")
    at = ["model", "corpus", "shard_id"]
    rows = t.join(traces.read(spark, uri, "topk"), [*at, "row_id"]).join(traces.read(spark, uri, "logits"), [*at, "row_id", "layer"])
    hidden = traces.read(spark, uri, "hidden").withColumnRenamed("index", "place")
    return rows.withColumn("place", F.col("doc_id") * 64 + F.col("pos")).join(hidden, [*at, "layer", "place"], "left")


def test_written_shards_hold_the_same_bytes(spark, tmp_path):
    """Small Arrow batches cut tokens and shards; a second write replaces the first; attempts leave nothing."""
    source, target = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    traces.synthetic(source, [40, 20, 30])
    rows = trace_rows(spark, source).withColumn("extra", F.lit("x")).cache()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for _ in range(2):
            found = {(r.shard_id, r.n_tokens, r.n_captured) for r in traces.write(rows, target, SHAPE).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(s, n) for s, n, _ in found} == {(0, 40), (1, 20), (2, 30)}
    files = sorted(p.relative_to(tmp_path / "a") for p in (tmp_path / "a").rglob("*") if p.is_file())
    assert files == sorted(p.relative_to(tmp_path / "b") for p in (tmp_path / "b").rglob("*") if p.is_file()) and len(files) == 18
    for f in files:
        a, b = (tmp_path / "a" / f).read_bytes(), (tmp_path / "b" / f).read_bytes()
        assert json.loads(a) == json.loads(b) if f.suffix == ".json" else a == b
    assert traces.read(spark, target).count() == 90


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda r: r.where("doc_id <> 1 OR pos <> 3 OR layer <> 2"), "lacks a layer"),
        (lambda r: r.where("doc_id <> 1 OR pos <> 3"), "gap or a repeated token"),
        (lambda r: r.unionByName(r.where("doc_id = 1")), "lacks a layer"),
        (lambda r: r.withColumn("hidden", F.when(F.col("layer") > 0, F.col("hidden"))), "captured in part"),
        (lambda r: r.withColumn("scores", F.slice("scores", 1, 15)), "without 16 values"),
        (lambda r: r.withColumn("scores", F.transform("scores", lambda x: x * 1e6)), "beyond half precision"),
        (lambda r: r.withColumn("token_id", F.when(F.col("pos") > 0, F.col("token_id"))), "null in its key"),
        (lambda r: r.withColumn("token_id", F.col("token_id") - 1000), "does not fit 32 bits"),
    ],
)
def test_traces_that_cannot_be_written(spark, tmp_path, change, message):
    traces.synthetic(f"file://{tmp_path}/a", [20])
    with pytest.raises(Exception, match=message):
        traces.write(change(trace_rows(spark, f"file://{tmp_path}/a")), f"file://{tmp_path}/b", SHAPE)
    assert not list(tmp_path.glob("b/*/*/*/manifest.json"))


def test_an_empty_trace_writes_nothing(spark, tmp_path):
    traces.synthetic(f"file://{tmp_path}/a", [10])
    assert traces.write(trace_rows(spark, f"file://{tmp_path}/a").where("false"), f"file://{tmp_path}/b", SHAPE).count() == 0
    assert not list(tmp_path.glob("b/**/*.bin"))


def test_columns_are_pruned_to_the_stream_and_sizes_are_checked(spark, tmp_path):
    uri = f"file://{tmp_path}"
    traces.synthetic(uri, [20])
    victim = next(tmp_path.rglob("topk.bin"))
    victim.write_bytes(victim.read_bytes()[:-4])
    with pytest.raises(Exception, match="topk.bin has"):
        traces.read(spark, uri, "tokens").count()
    assert traces.read(spark, uri, "tokens", validate_sizes="false").count() == 20


def test_mixed_configurations_are_refused(spark, tmp_path):
    traces.synthetic(f"file://{tmp_path}", [10, 10], overrides={1: {"run_config_sha256": "1" * 64}})
    with pytest.raises(Exception, match="run_config_sha256"):
        traces.read(spark, f"file://{tmp_path}").count()


def test_checks_healthy_and_corrupt(spark, root):
    t = traces.read(spark, root, "tokens").select("doc_id", F.col("pos_in_doc").alias("pos"), "token_id")
    assert validation.contiguity(t).first().out_of_step == 0
    assert validation.contiguity(t.where("NOT (doc_id = 3 AND pos = 4)")).first().out_of_step == 1
    assert validation.alignment(t, t).first().first_doc_id is None
    off = t.withColumn("token_id", F.when((F.col("doc_id") == 2) & (F.col("pos") >= 7), -1).otherwise(F.col("token_id")))
    a = validation.alignment(t, off).first()
    assert (a.different, a.first_doc_id, a.first_pos) == (3, 2, 7)
    with pytest.raises(checks.Refused):
        drift.require_aligned(validation.alignment(t, off))
    sizes = spark.createDataFrame([("topk", 40 * 48, 40, 48, 12), ("topk", 39 * 48, 40, 48, 12), ("topk", 40 * 48 - 12, 40, 48, 12), ("topk", 40 * 48 - 1, 40, 48, 12)], "stream string, bytes long, n_tokens long, per_token long, per_layer_row long")
    assert [r.fault for r in validation.size_arithmetic(sizes).collect()] == [None, "whole tokens", "layer rows", "ragged"]
    lock = spark.createDataFrame([(0, 5, 5, 5, 2, 2, 2), (1, 5, 4, 5, 2, 2, 2), (2, 5, 5, 5, 2, 1, 2)], "shard_id int, n_tokens int, n_topk int, n_logits int, n_hidden int, n_index int, n_flagged int")
    assert {r.shard_id: r.fault for r in validation.lockstep(lock).collect()} == {1: "token counts differ", 2: "captured counts differ"}
    findings = spark.createDataFrame([("usage", "warning", "dead")], "check string, severity string, message string")
    assert validation.verdict(findings) == checks.PASSED and validation.verdict(findings.withColumn("severity", F.lit("error"))) == checks.FAILED
    assert validation.stride_for(1000, 50) == 20 and validation.stride_for(10, 50) == 1 and validation.stride_for(10, 0) == 0


def test_injected_flips_give_exact_drift(spark):
    base = [float(x) for x in range(16, 0, -1)]
    flipped = list(base)
    flipped[2], flipped[3] = flipped[3], flipped[2]  # the third of three selected gives way
    rows = [(t, layer, base) for layer in range(4) for t in range(layer * 100, layer * 100 + 40)]
    other = [(t, layer, flipped if t % 100 < 10 * layer else base) for t, layer, _ in rows]
    a, b = (spark.createDataFrame(x, "token int, layer int, scores array<double>") for x in (rows, other))
    d = drift.per_layer(drift.pair(a, b, ["token"], 3))
    got = {r.layer: r for r in d.collect()}
    for layer in range(4):
        assert got[layer].flip_rate == pytest.approx(layer / 4) and got[layer].set_agreement == pytest.approx(1 - layer / 12)
    s = drift.summary(d).first()
    assert s.worst_layer == 3 and not s.equivalent and s.interpretation == "severe"
    assert drift.depth_trend(d).first().trend == pytest.approx(1.0)
    assert drift.gate(d, "cuda", "cpu") == checks.FAILED and drift.gate(d, "cpu", "cpu") == checks.COULD_NOT_RUN and drift.gate(d, None, None) == checks.COULD_NOT_RUN
    assert drift.gate(drift.per_layer(drift.pair(a, a, ["token"], 3)), "x", "y") == checks.PASSED


@pytest.mark.parametrize("kind", ["linear", "mlp"])
def test_gradients(kind):
    rng = np.random.default_rng(0)
    p = probes.Probe.new(kind, 5, 4, seed=1)
    p.parameters = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(float) for k, v in p.parameters.items()}
    x, y = rng.standard_normal((7, 5)), np.full((7, 4), 0.25)
    y = rng.dirichlet(np.ones(4), 7)
    for name, g in p.slopes(x, y).items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(4)]:
            old, eps = p.parameters[name][at], 1e-5
            losses = []
            for e in (eps, -eps):
                p.parameters[name][at] = old + e
                losses.append(p.loss(x, y))
            p.parameters[name][at] = old
            assert (losses[0] - losses[1]) / (2 * eps) == pytest.approx(g[at], abs=1e-5)


def test_network_beats_linear_on_a_product(spark):
    rng = np.random.default_rng(3)
    x = rng.choice([-1.0, 1.0], (3000, 2))
    rows = [(0, ["train", "val", "test"][i % 5 // 2 if i % 5 < 4 else 2], i, [float(a), float(b)], [0 if a * b > 0 else 1]) for i, (a, b) in enumerate(x)]
    frame = spark.createDataFrame(rows, "layer int, split string, row_key long, features array<float>, experts array<int>")
    linear = probes.evaluate(frame, "linear", 2).first()
    network = probes.evaluate(frame, "mlp", 2).first()
    assert network.set_agreement > 0.99 > 0.7 > linear.set_agreement
    # One bit to know, nearly all of which the network has; it stays within what the bound allows.
    assert network.entropy_bits == pytest.approx(1.0, abs=0.01) and network.mi_bits == pytest.approx(network.entropy_bits - network.cross_entropy_bits)
    assert network.n_slots == network.n_rows == sum(r[1] == "test" for r in rows) and not network.negative and network.ratio > 0.9 > 0.1 > linear.ratio
    assert network.recall_2k == network.recall_4k == 1.0
    again = probes.evaluate(frame.repartition(5), "mlp", 2).first()
    assert again.cross_entropy_bits == pytest.approx(network.cross_entropy_bits)


@pytest.mark.parametrize("alike", [None, ["kind"]])
def test_a_probe_is_fitted_on_every_row(spark, alike):
    """Rows of kind 1 are those that a sample of 20,000 of the train rows leaves out."""
    rows = spark.range(30_000).select(F.lit("train").alias("split"), F.col("id").alias("row_key"))
    rows = rows.withColumn("kind", (F.pmod(F.xxhash64("row_key"), F.lit(1 << 30)) >= F.lit((1 << 30) * 2 // 3)).cast("int"))
    assert 9_000 < rows.where("kind = 1").count() < 11_000
    others = spark.range(400).select(F.when(F.col("id") < 200, "val").otherwise("test").alias("split"), (F.col("id") + 30_000).alias("row_key"), (F.col("id") % 2).cast("int").alias("kind"))
    rows = rows.union(others).withColumn("layer", F.lit(0))
    made = F.array((F.col("kind") == 0).cast("float"), (F.col("kind") == 1).cast("float")), F.array("kind")
    given = {"alike": alike, "features": made[0], "experts": made[1]} if alike else {}
    r = probes.evaluate(rows if alike else rows.withColumns(dict(zip(("features", "experts"), made))), "linear", 2, **given).first()
    assert (r.n_rows, r.n_slots, r.set_agreement, r.exact_match) == (200, 200, 1.0, 1.0) and r.cross_entropy_bits < 0.05


def test_equal_rows_count_as_often_as_they_occur(spark, monkeypatch):
    times = np.random.default_rng(0).integers(1, 400, 100)
    monkeypatch.setattr(probes, "SHUFFLED", 3000)
    monkeypatch.setattr(probes, "BATCH", 256)
    batches = list(probes._orders(times, np.random.default_rng(1)))
    assert {len(b) for b in batches[:-1]} == {256} and (np.bincount(np.concatenate(batches), minlength=100) == times).all()
    assert np.unique(batches[0]).size > 60 and len(batches) == -(-times.sum() // 256)
    rng = np.random.default_rng(2)
    p = probes.Probe.new("mlp", 5, 4, seed=1)
    x, y, n = rng.standard_normal((7, 5)), rng.dirichlet(np.ones(4), 7), rng.integers(1, 5, 7)
    once, each = p.slopes(x, y, n), p.slopes(np.repeat(x, n, axis=0), np.repeat(y, n, axis=0))
    assert all(np.allclose(once[k], each[k], atol=1e-7) for k in each)
    assert p.loss(x, y, n) == pytest.approx(p.loss(np.repeat(x, n, axis=0), np.repeat(y, n, axis=0)))


@pytest.mark.parametrize("name, known", [("probe_linear_f2", "layer >= 1"), ("probe_linear_f3", "pos >= 1"), ("probe_f6", "layer >= 1 AND pos >= 1")])
def test_probe_queries_take_every_row_of_the_trace(spark, monkeypatch, name, known):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(probes, "evaluate", lambda rows, *_, **__: rows)
    monkeypatch.setattr(probe_queries, "_shown", lambda rows: rows)
    rows = frame(spark, d, "routed").join(frame(spark, d, "doc_splits"), "doc_id")
    expect = rows.where(known)
    seen = rows.where("split = 'train'").select("layer", "token_id").distinct()
    expect = expect.join(seen, ["layer", "token_id"], "left_semi") if name == "probe_f6" else expect
    by_split = lambda f: sorted((r.layer, r.split, r["count"]) for r in f.groupBy("layer", "split").count().collect())
    assert by_split(probe_queries.QUERIES[name](spark, d)) == by_split(expect)


def test_f6_shuffles_and_writes_a_few_bytes_a_token(spark):
    """Joined by row with its features written, it took 69 MB here, for 1.3 MB of tables."""
    shared = Path(tables.shared_dir(spark).removeprefix("file://"))
    written = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True)
    shuffled = lambda: sum(x.apply(i).totalShuffleWrite() for x in [executors()] for i in range(x.size()))
    before = written(), shuffled()
    assert probe_queries.QUERIES["probe_f6"](spark, "/root/testdata/sf0.01").count() == 3
    assert 0 < written() - before[0] < 2e6 and 0 < shuffled() - before[1] < 20e6


@pytest.mark.parametrize("n_experts", [5, 63, 130])
def test_packed_tokens_hold_the_sets_and_their_neighbours(spark, n_experts):
    """Tokens and layers with gaps, in any order; sets that reach into several words."""
    rng = np.random.default_rng(n_experts)
    sets = {(d, p, layer): sorted(rng.choice(n_experts, rng.integers(1, 5), replace=False).tolist()) for d in range(3) for p in range(7) for layer in range(3) if rng.random() < 0.7}
    sets[0, 0, 2], sets[0, 1, 2] = [0, n_experts - 1], [n_experts - 1]
    slots = [(d, p, 9, layer, e) for (d, p, layer), found in sets.items() for e in found]
    rng.shuffle(slots)
    frame = spark.createDataFrame([tuple(map(int, s)) for s in slots], "doc_id long, pos int, token_id long, layer int, expert int")
    tokens = probes.packed(frame, 3, n_experts)
    hot = lambda found: [float(e in found) for e in range(n_experts)]
    for on, other in (("below", (0, 0, 1)), ("before", (0, 1, 0)), (None, (0, 0, 0))):
        features = probes.hot("before" if on == "before" else "sets", F.col("layer") - int(on == "below"), n_experts)
        rows = probes.layered(tokens, 3, n_experts, **({on: True} if on else {})).select("doc_id", "pos", "layer", "experts", features.alias("x")).collect()
        found = {(r.doc_id, r.pos, r.layer): (list(r.experts), list(r.x)) for r in rows}
        known = {k: tuple(a - b for a, b in zip(k, other)) for k in sets}
        assert len(rows) == len(found) and found == {k: (sets[k], hot(sets[n])) for k, n in known.items() if n in sets}
    for layer, expert in ((0, n_experts), (0, -1), (3, 0)):
        with pytest.raises(Exception, match="out of range"):
            probes.packed(spark.createDataFrame([(0, 0, 9, layer, expert)], frame.schema), 3, n_experts).collect()


def test_the_hidden_vector_comes_from_the_layer_below(spark):
    rows = spark.createDataFrame([(d, 0, layer, "train", [layer]) for d in range(4) for layer in range(3)], "doc_id long, pos int, layer int, split string, experts array<int>")
    hidden = spark.createDataFrame([(d, 0, layer, [10.0 * d + layer]) for d in (0, 2) for layer in range(3)], "doc_id long, pos int, layer int, features array<float>")
    found = {(r.doc_id, r.layer): r.features for r in probes.below(rows, hidden).collect()}
    assert found == {(d, layer): [10.0 * d + layer - 1] for d in (0, 2) for layer in (1, 2)}
    counted = sorted(tuple(r) for r in probes.below_exclusions(rows, hidden, "F4").collect())
    assert counted == [(0, "F4", 0, 4, "no layer below"), (1, "F4", 2, 2, "hidden vector not captured"), (2, "F4", 2, 2, "hidden vector not captured")]


@pytest.mark.parametrize("name", ["probe_linear_f4", "probe_mlp_f5"])
def test_f4_and_f5_are_not_fed_the_routers_own_input(spark, monkeypatch, name):
    monkeypatch.setattr(probes, "evaluate", lambda rows, *_, **__: rows)
    monkeypatch.setattr(probe_queries, "_shown", lambda rows: rows)
    rows = probe_queries.QUERIES[name](spark, "/root/testdata/sf0.001").limit(40).collect()
    assert rows and {r.layer for r in rows} == {1}
    for r in rows:
        x = np.array(r.features, float)
        size = np.abs(x + np.roll(x, -1))
        assert sorted(r.experts) == sorted(np.lexsort((np.arange(64), -size))[:8].tolist())
        assert sorted(r.experts) != sorted(np.lexsort((np.arange(64), -x))[:8].tolist())


def cell(layer, h, ce, **more):
    b = {"entropy_bits": h, "cross_entropy_bits": ce, "mi_bits": h - ce}
    return {"layer": layer, "model_layer": layer + 1, "status": "ok", "metrics": {"split": "test", "n_rows": 5, "n_slots": 10, "family_a": {"recall@8": 0.5}, "family_b": b | more}}


def test_result_documents(spark, tmp_path):
    base = {"model": "m", "run_config_sha256": "a", "logit_tensor_used": "t", "n_moe_layers": 2, "n_experts": 64, "top_k": 8}
    (tmp_path / "m__F1.json").write_text(json.dumps(base | {"feature": "F1", "layers": {"0": cell(0, 4.0, 3.0), "1": {"layer": 1, "model_layer": 2, "status": "skipped", "reason": "no layer"}}}, indent=1))
    (tmp_path / "notes.json").write_text("not a result")
    cells = documents.read_results(spark, f"file://{tmp_path}")
    panel = spark.createDataFrame([("m", 2, 64, 8)], "model string, n_moe_layers int, n_experts int, top_k int")
    value = documents.metric(cells, "family_a", reports.recall_key(1, F.col("top_k")))
    g = {r.layer: (r.value, r.missing) for r in reports.grid(panel, cells, value).collect()}
    assert g == {0: (0.5, None), 1: (None, "skipped")}
    with pytest.raises(checks.Refused):
        reports.require_models(panel, ["absent"])
    (tmp_path / "m__F2.json").write_text(json.dumps(base | {"feature": "F2", "layers": {"0": cell(0, 4.0, 3.0, mi_bits=0.5)}}))
    with pytest.raises(checks.Refused, match="entropy minus"):
        documents.read_results(spark, f"file://{tmp_path}")
    (tmp_path / "m__F2.json").write_text(json.dumps(base | {"feature": "F2", "run_config_sha256": "b", "layers": {}}))
    with pytest.raises(checks.Refused, match="configurations"):
        documents.read_results(spark, f"file://{tmp_path}")


def test_corpus_lines(spark, tmp_path):
    docs = spark.createDataFrame([(1, "é\n\"x\" 😀", "prose", "en", "s", 3, "train", 0), (2, "b", "code", "", "s", 1, "test", 1)], documents.CORPUS)
    documents.write_corpus(docs, f"file://{tmp_path}/c")
    line = next(x for p in (tmp_path / "c").rglob("*.txt") for x in p.read_text().splitlines() if '"doc_id":1' in x)
    assert line.isascii() and list(json.loads(line)) == list(documents.FIELDS)
    back = documents.read_corpus(spark, f"file://{tmp_path}/c")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    assert documents.doc_splits(back).count() == 2
    with pytest.raises(checks.Refused):
        documents.doc_splits(back.unionByName(back))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.txt").write_text('\n{"doc_id": 1, "text": "t"}\n')
    with pytest.raises(checks.Refused):
        documents.read_corpus(spark, f"file://{tmp_path}/bad")


def test_logs_and_measurements(spark):
    log = ["common_debug_cb_eval:   ffn_moe_topk-11 = (i32) VIEW(ffn_moe_argsort-11{64, 5, 1, 1}, }) = {8, 5, 1, 1}", "   [0.1, 0.2]", "common_debug_cb_eval: inp_embd = (f32) GET_ROWS(token_embd.weight{2048, 50304, 1, 1}, inp_tokens{5, 1, 1, 1}}) = {2048, 5, 1, 1}"]
    nodes = documents.parse_nodes(spark.createDataFrame([(x,) for x in log], "value string")).collect()
    assert [(n.base, n.il, n.dtype, n.op, n["shape"], n.sources) for n in nodes] == [("ffn_moe_topk", 11, "i32", "VIEW", [8, 5, 1, 1], ["ffn_moe_argsort-11"]), ("inp_embd", None, "f32", "GET_ROWS", [2048, 5, 1, 1], ["token_embd.weight", "inp_tokens"])]
    counts = documents.node_counts(documents.parse_nodes(spark.createDataFrame([(x,) for x in log], "value string")), ["ffn_moe_topk", "ffn_moe_probs"]).collect()
    assert {(c.base, c.n) for c in counts} == {("ffn_moe_topk", 1), ("ffn_moe_probs", 0)}
    runs = [{"model_filename": "a", "n_prompt": 512, "n_gen": 0, "avg_ts": 200.5, "build_commit": "abc"}, {"model_filename": "a", "n_prompt": 0, "n_gen": 128, "avg_ts": 20.5, "build_commit": "abc"}]
    texts = spark.createDataFrame([(json.dumps(runs),)], "value string")
    assert [r.avg_ts for r in documents.parse_bench(texts, "abcdef").collect()] == [200.5]
    with pytest.raises(checks.Refused):
        documents.parse_bench(texts, "fff")
    with pytest.raises(checks.Refused):
        documents.parse_bench(spark.createDataFrame([(json.dumps(runs[1:]),)], "value string"))


def test_checkpoint_header(spark, tmp_path):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    data = b"GGUF" + struct.pack("<IQQ", 3, 2, 2) + text("k") + struct.pack("<I", 8) + text("v") + text("list") + struct.pack("<IIQ", 9, 4, 3) + b"\0" * 12
    for i, name in enumerate(("router.weight", "up.weight")):
        data += text(name) + struct.pack("<IQQIQ", 2, 8, 16, i, 64 * i)
    (tmp_path / "m.gguf").write_bytes(data + b"\0" * 100)
    got = checkpoints.read_headers(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [(r.name, list(r.dims), r.type, r.offset) for r in got] == [("router.weight", [8, 16], 0, 0), ("up.weight", [8, 16], 1, 64)]
    assert checkpoints.file_digests(spark, f"file://{tmp_path}").count() == 1
    assert documents.canonical_hash({"b": 1, "a": [1, 2]}) == documents.canonical_hash({"a": [1, 2], "b": 1})
    assert documents.parse_shard_ids("0-2, 7") == [0, 1, 2, 7]
    with pytest.raises(checks.Refused):
        documents.parse_shard_ids("1-x")


def test_ingest_counts_each_file_once(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    add = lambda rows: spark.createDataFrame(rows, ingest.SLOTS).coalesce(1).write.mode("append").parquet(folder)
    add([(0, 0, 0, 1), (0, 0, 0, 2)])
    ingest.ingest(ingest.slots_stream(spark, folder), out, f"file://{tmp_path}/cp").awaitTermination()
    add([(1, 0, 0, 1), (1, 0, 1, 3)])
    for _ in range(2):
        ingest.ingest(ingest.slots_stream(spark, folder), out, f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, ingest.totals(spark, out).collect())) == [(0, 1, 2), (0, 2, 1), (1, 3, 1)]
