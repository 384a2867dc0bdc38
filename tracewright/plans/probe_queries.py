"""Fitted probes. Rows only: a trained model has no SQL; tests hold them to planted structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import counts, information, probes
from ..operators.checks import rounded
from ..operators.tables import dealt, kept
from .views import N_EXPERTS, N_LAYERS, N_SCORES, SCORE_K, TOP_K, frame


def _tokens(spark, d):
    """A row per token with its split and packed sets, written once: a few bytes each. Features and rows by layer
    are made when they are read.

    The views name the document anew, and Spark does not see that what lies by the old name lies by the new one
    too unless the lines are dealt out before: then they are shuffled once, and neither tokens nor slots after."""
    lines = frame(spark, d, "lineitem").repartition("l_orderkey")
    tokens = probes.packed(frame(spark, d, "slots", {"lineitem": lines}), N_LAYERS, N_EXPERTS)
    return dealt(tokens.join(frame(spark, d, "doc_splits"), "doc_id"), ["split"])


def _shown(r):
    return r.select("layer", "n_rows", *[rounded(F.col(c), 4).alias(c) for c in ("cross_entropy_bits", "set_agreement", "exact_match")])


def _fitted(rows, neighbours, block=None):
    """The probe of the sets at ``neighbours``: columns of one packed set each. What decides a row are those, its
    own set and, where a ``block`` of features by layer and token comes first, the token."""
    sets = {"own": ("sets", 0), "below": ("sets", 1), "before": ("before", 0)}
    rows = rows.withColumns({c: probes.only(sets[c][0], F.col("layer") - sets[c][1], N_EXPERTS) for c in ("own", *neighbours)})
    features = [probes.hot(c, F.lit(0), N_EXPERTS) for c in neighbours]
    features = probes.joined(*([] if block is None else [F.col("block")]), *features)
    alike = ["own", *neighbours, *([] if block is None else ["token_id"])]
    return _shown(probes.evaluate(rows, "linear", N_EXPERTS, alike=alike, features=features, experts=probes.listed("own", F.lit(0), N_EXPERTS), table=block))


def probe_linear_f2(spark, d):
    return _fitted(probes.layered(_tokens(spark, d), N_LAYERS, N_EXPERTS, below=True), ["below"])


def probe_linear_f3(spark, d):
    return _fitted(probes.layered(_tokens(spark, d), N_LAYERS, N_EXPERTS, before=True), ["before"])


def _f1_block(rows):
    """Log probabilities of every expert by the fitted F1 table, for each (layer, token) of the trace; a
    token that train lacks has the prior. Rows are at most vocabulary times layers, of one value an expert."""
    keys = ["layer"]
    # Experts are counted side by side: no row per slot.
    times_ = F.array(*[F.sum(b) for b in probes.bits("sets", F.col("layer"), N_EXPERTS)])
    counted = rows.groupBy("split", *keys, "token_id").agg(times_.alias("times"))
    all_ = kept(counted.select("split", *keys, "token_id", F.posexplode("times").alias("expert", "times")).where("times > 0"))
    train, val = (all_.where(F.col("split") == x).drop("split") for x in ("train", "val"))
    alpha = counts.best_alpha(counts.alpha_grid(train, val, keys, N_EXPERTS, TOP_K), keys)
    prior = information.marginal(information.slot_counts(train, keys, N_EXPERTS, "times"), keys, smoothing=1.0)
    prior = prior.groupBy("layer").agg(F.transform(F.sort_array(F.collect_list(F.struct("expert", "p"))), lambda x: x["p"]).alias("prior"))
    seen = train.groupBy("layer", "token_id").agg(F.map_from_entries(F.collect_list(F.struct("expert", "times"))).alias("seen"), F.sum("times").alias("row_n"))
    strength = F.col("alpha") * F.lit(float(TOP_K))
    times = lambda e: F.coalesce(F.element_at("seen", e), F.lit(0))
    p = lambda e: (times(e.cast("int")) + strength * F.get("prior", e.cast("int"))) / (F.coalesce("row_n", F.lit(0)) + strength)
    tokens = all_.select("layer", "token_id").distinct().join(seen, ["layer", "token_id"], "left").join(F.broadcast(prior.join(alpha, "layer")), "layer")
    return tokens.select("layer", "token_id", F.transform(F.sequence(F.lit(0), F.lit(N_EXPERTS - 1)), lambda e: F.log(p(e))).alias("f1"))


def probe_f6(spark, d):
    """Three blocks: log probabilities of the fitted F1 table, the set below, the set before."""
    tokens = _tokens(spark, d)
    # As a table its size is known, so Spark joins it without a shuffle of the rows where it is small.
    f1 = dealt(_f1_block(probes.layered(tokens, N_LAYERS, N_EXPERTS)), [])
    rows = probes.layered(tokens, N_LAYERS, N_EXPERTS, below=True, before=True)
    return _fitted(rows, ["below", "before"], f1.withColumnRenamed("f1", "block"))


def _hidden(spark, d):
    """A score row as the hidden vector whose ranking is the selection."""
    e = frame(spark, d, "embeddings")
    scores = F.transform("embedding", lambda x: x.cast("double"))
    split = F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 < 8, "val").otherwise("test")
    return e.select(F.lit(0).alias("layer"), split.alias("split"), F.col("vec_id").alias("row_key"), F.col("embedding").alias("features"), arrays.top_m(scores, SCORE_K).alias("experts"))


def probe_fv(spark, d):
    return _shown(probes.evaluate(_hidden(spark, d), "linear", N_SCORES, dense=True))


def _two_layers(spark, d):
    """The trace of ``_hidden`` and a layer above it, whose hidden vector holds the sizes of the sums of
    neighbours in the one below: rows to predict, and all hidden vectors."""
    low = _hidden(spark, d).select(F.col("row_key").alias("doc_id"), F.lit(0).alias("pos"), "layer", "split", "features", "experts")
    x = F.transform("features", lambda v: v.cast("double"))
    sums = F.zip_with(x, F.concat(F.slice(x, 2, N_SCORES - 1), F.slice(x, 1, 1)), lambda a, b: F.abs(a + b))
    high = low.withColumns({"layer": F.lit(1), "features": sums.cast("array<float>"), "experts": arrays.top_m(sums, SCORE_K)})
    both = low.unionByName(high)
    return both.drop("features"), both.select("doc_id", "pos", "layer", "features")


def probe_linear_f4(spark, d):
    return _shown(probes.evaluate(probes.below(*_two_layers(spark, d)), "linear", N_SCORES, dense=True))


def probe_mlp_f5(spark, d):
    return _shown(probes.evaluate(probes.below(*_two_layers(spark, d)), "mlp", N_SCORES, dense=True))


def exclusions_f4(spark, d):
    """Of F5 too: both take the same rows."""
    return probes.below_exclusions(*_two_layers(spark, d), "F4")


QUERIES = {"probe_linear_f2": probe_linear_f2, "probe_linear_f3": probe_linear_f3, "probe_f6": probe_f6, "probe_fv": probe_fv, "probe_linear_f4": probe_linear_f4, "probe_mlp_f5": probe_mlp_f5, "exclusions_f4": exclusions_f4}
ORACLE_SQL = {
    "exclusions_f4": """SELECT CAST(layer AS INT) AS layer, 'F4' AS feature, CASE WHEN layer = 0 THEN 0 ELSE n END AS kept, CASE WHEN layer = 0 THEN n ELSE 0 END AS excluded,
  CASE WHEN layer = 0 AND n > 0 THEN 'no layer below' END AS reason FROM (SELECT count(*) AS n FROM embeddings) CROSS JOIN (SELECT unnest([0, 1]) AS layer)""",
}
