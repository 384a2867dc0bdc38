import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import assembly, checks, corpus, ledger, reports
from tracewright.plans import catalogue


def test_shard_plan_refuses_interleaving(spark):
    rows = [(0, 0, 5), (1, 0, 5), (2, 1, 7), (3, 1, 1)]
    frame = spark.createDataFrame(rows, "position long, shard_id int, n_tokens long")
    assert sorted((r.shard_id, r.n_docs, r.n_tokens, r.token_offset) for r in ledger.plan_shards(frame).collect()) == [(0, 2, 10, 0), (1, 2, 8, 10)]
    with pytest.raises(checks.Refused):
        ledger.plan_shards(frame.withColumn("shard_id", F.col("position").cast("int") % 2))


def test_half_precision(spark):
    values = [1.0, 1.0004, 1.0005, 65504.0, 1e-8, float("nan"), float("inf"), -0.1]
    frame = spark.createDataFrame([(values,), ([],)], "v array<double>")
    got, none = frame.select(ledger.half(F.col("v")).alias("h"), F.size("v").alias("n")).orderBy(F.desc("n")).collect()
    assert got.h[0] == got.h[1] == 1.0 and got.h[2] == 1.0009765625 and got.h[3] == 65504.0 and got.h[4] == 0.0 and got.h[5] != got.h[5] and none.h == []


def test_router_recheck(spark):
    weights = [(0, e, [1.0 if i == e else 0.0 for i in range(4)]) for e in range(4)]
    hidden = [(0, 0, [0.1, 0.4, 0.3, 0.2]), (1, 0, [0.1, 0.40001, 0.40002, 0.9]), (2, 0, [0.9, 0.1, 0.5, 0.2])]
    selected = [(0, 0, [2, 1]), (1, 0, [3, 1]), (2, 0, [0, 3])]
    r = ledger.recheck_router(
        spark.createDataFrame(hidden, "token int, layer int, hidden array<double>"),
        spark.createDataFrame(weights, "layer int, expert int, weight array<double>"),
        spark.createDataFrame(selected, "token int, layer int, experts array<int>"), 2,
    ).first()
    assert (r.n, r.agree, r.tied, r.unexplained) == (3, 1, 1, 1)


def test_missing_is_never_a_number_in_any_rendering(spark):
    frame = spark.createDataFrame([("a|b", 0.1, None), ("c", float("nan"), 0.0)], "model string, x double, y double")
    md, table, data = (ledger.render(frame, k) for k in ("markdown", "csv", "json"))
    assert "| a\\|b | 0.1 | -- |" in md and "| c | nan | 0.0 |" in md and "a|b,0.1,--" in table and json.loads(data)["rows"][0] == ["a|b", 0.1, None]
    with pytest.raises(ValueError):
        ledger.render(frame, "html")


def test_holes_keep_their_kind(spark):
    panel = spark.createDataFrame([("m", 3, 8, 2), ("n", 1, 8, 2)], "model string, n_moe_layers int, n_experts int, top_k int")
    cells = spark.createDataFrame([("m", "F1", 0, "ok", 0.0), ("m", "F1", 1, "skipped", None), ("n", "F2", 0, "ok", None)], "model string, feature string, layer int, status string, x double")
    g = reports.grid(panel, cells, F.col("x"))
    got = {(r.model, r.feature, r.layer): (r.value, r.missing) for r in g.collect()}
    assert got == {
        ("m", "F1", 0): (0.0, None), ("m", "F1", 1): (None, "skipped"), ("m", "F1", 2): (None, "not_reached"), ("n", "F1", 0): (None, "feature_absent"),
        ("m", "F2", 0): (None, "feature_absent"), ("m", "F2", 1): (None, "feature_absent"), ("m", "F2", 2): (None, "feature_absent"), ("n", "F2", 0): (None, "metric_absent"),
    }
    mean = {(r.model, r.feature): (r.value, r.n_used, r.n_expected, r.holes, r.missing) for r in reports.primary_mean(g).collect()}
    assert mean[("m", "F1")] == (0.0, 1, 3, "not_reached,skipped", None) and mean[("n", "F2")] == (None, 0, 1, "metric_absent", "no_layers")


def test_cache_budget_follows_each_models_k(spark):
    """A model whose 4k exceeds its experts has two budgets; a layer without a curve has no recall."""
    panel = spark.createDataFrame([("a", 2, 8, 2), ("b", 1, 6, 3)], "model string, n_moe_layers int, n_experts int, top_k int")
    curves = spark.createDataFrame([("a", 0, 2, 0.25), ("a", 0, 4, 0.5), ("a", 0, 8, 1.0), ("b", 0, 3, 0.75)], "model string, layer int, m int, recall double")
    found = {(r.model, r.layer, r.m): (r.share, r.recall) for r in reports.cache_budget(panel, curves).collect()}
    assert found == {
        ("a", 0, 2): (0.25, 0.25), ("a", 0, 4): (0.5, 0.5), ("a", 0, 8): (1.0, 1.0), ("a", 1, 2): (0.25, None), ("a", 1, 4): (0.5, None), ("a", 1, 8): (1.0, None),
        ("b", 0, 3): (0.5, 0.75), ("b", 0, 6): (1.0, None),
    }
    assert reports.axes(spark).count() == len(reports.AXES)


def test_assembly_respects_budgets_rows_and_what_was_never_read(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(i, words(f"p{i}x", 30), "en", "web", i) for i in range(12)]
    rows += [(100, words("p0x", 30), "fr", "web", 100), (101, words("q", 30), "fr", "web", 101)]
    for r in range(3):
        rows += [(200 + 2 * r, words(f"r{r}e", 20), "en", "pair", r), (201 + 2 * r, words(f"r{r}f", 20) if r != 1 else "x", "fr", "pair", r)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long")
    sources = [corpus.Source("web", "multilingual", 9), corpus.Source("pair", "multilingual", 1, control=True)]
    shares = dict.fromkeys(corpus.SHARES, 0.0) | {"multilingual": 1.0}
    old, corpus.SHARES = corpus.SHARES, shares
    try:
        out, reports_, problems = assembly.assemble(docs, 1000, sources, {"web": ["en", "fr"], "pair": ["en", "fr"]}, 4, 512, normalise=T.normalise_lines)
    finally:
        corpus.SHARES = old
    got = out.collect()
    assert {r.doc_id for r in got if r.source == "pair"} <= {200, 201, 204, 205} and sum(r.source == "pair" for r in got) % 2 == 0
    by = {(r["source"], r["lang"]): r for r in reports_}
    assert by["pair", None]["dropped"]["too_short"] == 1
    first = assembly.language_order("web", ["en", "fr"])[0]
    assert by["web", first]["budget"] <= by["web", "fr" if first == "en" else "en"]["budget"] + 1000
    ids = {r.doc_id for r in got}
    # the French copy of an English text is a duplicate only if the English one was delivered first
    assert not (0 in ids and 100 in ids)


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 80


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
