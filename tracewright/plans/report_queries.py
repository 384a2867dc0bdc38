"""Queries over result cells and throughput measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, validation
from ..operators.checks import rounded
from .score_queries import RECALL_SQL, topm_recall_curve
from .views import frame, with_views

FEATURES = ("F0", "F1", "F2", "F3", "F4")


def _grid(spark, d, metric="mi_bits"):
    value = F.col("mi_bits") / F.col("entropy_bits") if metric == "mi_ratio" else F.col(metric)
    return reports.grid(frame(spark, d, "panel"), frame(spark, d, "cells"), value)


_GRID = """feats AS (SELECT DISTINCT feature FROM cells),
  have AS (SELECT DISTINCT model, feature FROM cells),
  g AS (SELECT p.model, p.n_moe_layers, p.n_experts, p.top_k, f.feature, CAST(l.layer AS INT) AS layer,
      CASE WHEN c.status = 'ok' THEN {metric} END AS value,
      CASE WHEN h.model IS NULL THEN 'feature_absent' WHEN c.status IS NULL THEN 'not_reached' WHEN c.status = 'skipped' THEN 'skipped' END AS missing,
      CASE WHEN p.n_moe_layers <= 1 THEN 0.0::DOUBLE ELSE l.layer / (p.n_moe_layers - 1)::DOUBLE END AS depth
    FROM panel p CROSS JOIN feats f JOIN (SELECT unnest(range(6)) AS layer) l ON l.layer < p.n_moe_layers
    LEFT JOIN have h ON h.model = p.model AND h.feature = f.feature
    LEFT JOIN cells c ON c.model = p.model AND c.feature = f.feature AND c.layer = l.layer)"""


def _sql(select: str, metric: str = "c.mi_bits") -> str:
    return with_views("WITH " + _GRID.replace("{metric}", metric) + select, "panel", "cells")


def primary_mean(spark, d):
    return reports.primary_mean(_grid(spark, d)).select("model", "feature", rounded(F.col("value")).alias("value"), "n_used", "n_expected", "holes", "missing")


PRIMARY_MEAN_SQL = _sql(
    """
  SELECT model, feature, round(avg(value), 9) AS value, count(value) AS n_used, count(*) AS n_expected,
  coalesce(string_agg(DISTINCT missing, ',' ORDER BY missing), '') AS holes, CASE WHEN count(value) = 0 THEN 'no_layers' END AS missing FROM g GROUP BY model, feature"""
)


def primary_per_layer(spark, d):
    g = _grid(spark, d, "mi_ratio")
    return g.select("model", "feature", "layer", rounded(F.col("value")).alias("value"), "missing")


PER_LAYER_SQL = _sql("\n  SELECT model, feature, layer, round(value, 9) AS value, missing FROM g", "c.mi_bits / c.entropy_bits")


def primary_wide(spark, d):
    g = _grid(spark, d).withColumn("value", rounded(F.col("value")))
    return reports.pivoted(g, ["model", "layer"], FEATURES)


WIDE_SQL = _sql("\n  SELECT model, layer, " + ", ".join(f"round(max(value) FILTER (feature = '{f}'), 9) AS {f}" for f in FEATURES) + " FROM g GROUP BY model, layer")


def primary_depth_bins(spark, d):
    b = reports.primary_depth(_grid(spark, d))
    return b.select("model", "feature", "bin", "label", "n_layers", rounded(F.col("value")).alias("value"), "missing")


DEPTH_SQL = _sql(
    """
  SELECT s.model, s.feature, CAST(s.bin AS INT) AS bin, printf('[%.2f,%.2f', s.bin / 5.0, (s.bin + 1) / 5.0) || CASE WHEN s.bin = 4 THEN ']' ELSE ')' END AS label,
  count(DISTINCT g.layer) AS n_layers, round(avg(g.value), 9) AS value, CASE WHEN count(g.value) = 0 THEN 'no_layers' END AS missing
  FROM (SELECT DISTINCT model, feature, bin FROM g CROSS JOIN (SELECT unnest(range(5)) AS bin)) s
  LEFT JOIN g ON g.model = s.model AND g.feature = s.feature AND least(CAST(floor(g.depth * 5) AS INT), 4) = s.bin GROUP BY ALL"""
)


def negative_mi_cells(spark, d):
    return reports.negative_cells(frame(spark, d, "cells")).select("model", "feature", "layer", "model_layer", rounded(F.col("mi_bits")).alias("mi_bits"))


NEGATIVE_SQL = with_views("SELECT model, feature, layer, model_layer, round(mi_bits, 9) AS mi_bits FROM cells WHERE status = 'ok' AND mi_bits < 0", "cells")


def negative_mi_summary(spark, d):
    return reports.negative_summary(_grid(spark, d))


NEGATIVE_SUMMARY_SQL = _sql("\n  SELECT model, feature, count(*) FILTER (value < 0) AS negative, count(value) AS examined, count(missing) AS missing FROM g GROUP BY model, feature")


def pair_table(spark, d):
    rows = reports.primary_mean(_grid(spark, d, "mi_ratio"))
    p = reports.pair_table(rows, [], "alpha", "beta")
    return p.select("feature", *[rounded(F.col(c)).alias(c) for c in ("a", "b", "delta")], "missing_a", "missing_b")


PAIR_SQL = _sql(
    """, m AS (SELECT model, feature, avg(value) AS value, CASE WHEN count(value) = 0 THEN 'no_layers' END AS missing FROM g GROUP BY model, feature)
  SELECT feature, round(max(value) FILTER (model = 'alpha'), 9) AS a, round(max(value) FILTER (model = 'beta'), 9) AS b,
    round(max(value) FILTER (model = 'beta') - max(value) FILTER (model = 'alpha'), 9) AS delta,
    max(missing) FILTER (model = 'alpha') AS missing_a, max(missing) FILTER (model = 'beta') AS missing_b FROM m GROUP BY feature""",
    "c.mi_bits / c.entropy_bits",
)


def confound_table(spark, d):
    measured = frame(spark, d, "cells").where("feature = 'F0' AND model <> 'gamma'").select("model", F.col("agreement").alias("load_balance"))
    c = reports.confounds(frame(spark, d, "panel"), measured)
    return c.select("model", "n_experts", "top_k", "density", "aux_loss", rounded(F.col("load_balance")).alias("load_balance"), "n_layers_measured")


CONFOUND_SQL = with_views(
    """SELECT p.model, n_experts, top_k, top_k / n_experts::DOUBLE AS density, aux_loss, round(avg(agreement), 9) AS load_balance, count(agreement) AS n_layers_measured
  FROM panel p LEFT JOIN cells c ON c.model = p.model AND c.feature = 'F0' AND c.model <> 'gamma' GROUP BY ALL""",
    "panel", "cells",
)


def shape_ladder(spark, d):
    return reports.ladder(_grid(spark, d, "mi_ratio"))


SHAPE_LADDER_SQL = _sql(
    """, r AS (SELECT *, value - lag(value) OVER (PARTITION BY model, layer ORDER BY feature) AS step FROM g WHERE feature IN ('F0', 'F1', 'F2', 'F4') AND missing IS DISTINCT FROM 'feature_absent'),
  l AS (SELECT model, layer, count(*) AS present, count(value) AS valued, bool_and(coalesce(step >= 0, TRUE)) AS ordered FROM r GROUP BY model, layer),
  n AS (SELECT model, count(*) FILTER (valued = present AND present >= 2) AS n_layers, count(*) FILTER (valued = present AND present >= 2 AND ordered) AS n_ordered FROM l GROUP BY model)
  SELECT *, CASE WHEN n_layers = 0 THEN 'not_evaluable' WHEN n_ordered = n_layers THEN 'agrees' WHEN n_ordered = 0 THEN 'disagrees' ELSE 'mixed' END AS verdict FROM n""",
    "c.mi_bits / c.entropy_bits",
)


def shape_depth(spark, d):
    s = reports.depth_shape(_grid(spark, d, "mi_ratio").where("feature = 'F1'"))
    return s.select("model", "n_layers", rounded(F.col("spread")).alias("spread"), "peak_layer", "trough_layer", "verdict")


SHAPE_DEPTH_SQL = _sql(
    """, v AS (SELECT * FROM g WHERE feature = 'F1' AND value IS NOT NULL),
  s AS (SELECT model, count(*) AS n_layers, max(value) - min(value) AS spread, arg_min(layer, (-value, layer)) AS peak_layer, arg_min(layer, (value, layer)) AS trough_layer,
      arg_min(depth, (-value, layer)) AS peak_depth, max(value) AS top, arg_min(value, layer) AS f, arg_max(value, layer) AS l FROM v GROUP BY model)
  SELECT model, n_layers, round(spread, 9) AS spread, peak_layer, trough_layer, CASE WHEN n_layers < 3 THEN 'not_evaluable' WHEN spread <= 0.001 THEN 'disagrees'
    WHEN peak_depth > 0 AND peak_depth < 1 AND top - greatest(f, l) > 0.001 THEN 'agrees' ELSE 'mixed' END AS verdict FROM s""",
    "c.mi_bits / c.entropy_bits",
)


def verdict_counts(spark, d):
    return reports.verdict_histogram(reports.ladder(_grid(spark, d, "mi_ratio")).select("verdict").unionByName(reports.depth_shape(_grid(spark, d, "mi_ratio").where("feature = 'F1'")).select("verdict")))


VERDICT_SQL = f"""SELECT v.verdict, count(s.verdict) AS n FROM (SELECT unnest(['agrees', 'mixed', 'disagrees', 'not_evaluable']) AS verdict) v
  LEFT JOIN (SELECT verdict FROM ({SHAPE_LADDER_SQL}) UNION ALL SELECT verdict FROM ({SHAPE_DEPTH_SQL})) s ON s.verdict = v.verdict GROUP BY v.verdict"""


def reconcile_nearest_depth(spark, d):
    points = frame(spark, d, "cells").where("feature = 'F3' AND status = 'ok'").select("model", "layer", "repetition").join(frame(spark, d, "panel"), "model")
    r = reports.nearest_depth(reports.figures(spark), points)
    chance = F.col("top_k") / F.col("n_experts")
    return r.select("figure", "model", "layer", rounded(F.col("error")).alias("error"), rounded(F.col("repetition")).alias("repetition"), rounded(F.col("repetition") - chance).alias("excess"), "low", "high", rounded(F.col("low") - F.col("chance")).alias("low_excess"))


RECONCILE_SQL = with_views(
    """WITH f AS (SELECT * FROM (VALUES ('first_choice_layer0', 0, 0.136::DOUBLE, 0.149::DOUBLE, 0.125::DOUBLE), ('first_choice_layer15', 15, 0.236::DOUBLE, 0.284::DOUBLE, 0.125::DOUBLE),
    ('first_choice_layer31', 31, 0.197::DOUBLE, 0.263::DOUBLE, 0.125::DOUBLE), ('first_or_second_choice_layer15', 15, 0.616::DOUBLE, 0.670::DOUBLE, NULL)) t(figure, fl, low, high, chance)),
  j AS (SELECT f.*, p.*, c.layer, c.repetition, abs(CASE WHEN n_moe_layers <= 1 THEN 0.0::DOUBLE ELSE c.layer / (n_moe_layers - 1)::DOUBLE END - fl / 31.0::DOUBLE) AS error
    FROM f CROSS JOIN panel p JOIN cells c ON c.model = p.model AND c.feature = 'F3' AND c.status = 'ok')
  SELECT figure, model, layer, round(error, 9) AS error, round(repetition, 9) AS repetition, round(repetition - top_k / n_experts::DOUBLE, 9) AS excess, low, high, round(low - chance, 9) AS low_excess
  FROM (SELECT *, row_number() OVER (PARTITION BY figure, model ORDER BY error, layer) AS n FROM j) WHERE n = 1""",
    "panel", "cells",
)


def cache_budget(spark, d):
    """The score rows are the traces of alpha, whose shape they have; the other models have no curve."""
    curves = topm_recall_curve(spark, d).withColumn("model", F.lit("alpha"))
    b = reports.cache_budget(frame(spark, d, "panel"), curves)
    return b.withColumns({"share": rounded(F.col("share")), "recall": rounded(F.col("recall"))})


CACHE_SQL = with_views(
    f"""WITH curve AS ({RECALL_SQL}),
  budgets AS (SELECT DISTINCT model, n_moe_layers, n_experts, least(top_k * t, n_experts) AS m FROM panel CROSS JOIN (SELECT unnest([1, 2, 4]) AS t)),
  spine AS (SELECT *, unnest(range(n_moe_layers))::INTEGER AS layer FROM budgets)
  SELECT s.model, s.layer, s.m, round(s.m / s.n_experts::DOUBLE, 9) AS share, c.recall FROM spine s LEFT JOIN curve c ON s.model = 'alpha' AND c.layer = s.layer AND c.m = s.m""",
    "panel",
)


def run_config_conflicts(spark, d):
    """Merge-invariant fields that differ between shards; here the shards are suppliers' nations."""
    n = frame(spark, d, "nation")
    shards = n.select(F.col("n_nationkey").alias("shard_id"), F.lit("cfg").alias("run_config_sha256"), (F.col("n_regionkey") % 2).alias("n_experts"), F.when(F.col("n_nationkey") > 3, "q4").alias("quant"))
    return validation.conflicts(shards, ("run_config_sha256", "n_experts", "quant"))


CONFLICTS_SQL = """SELECT 'n_experts' AS field, count(DISTINCT n_regionkey % 2) AS n_values FROM nation HAVING count(DISTINCT n_regionkey % 2) > 1
  UNION ALL SELECT 'quant', count(DISTINCT CASE WHEN n_nationkey > 3 THEN 'q4' ELSE '<missing>' END) FROM nation HAVING count(DISTINCT CASE WHEN n_nationkey > 3 THEN 'q4' ELSE '<missing>' END) > 1"""


def overhead_ratio(spark, d):
    t = frame(spark, d, "supplier").select(F.element_at(F.array(F.lit("no-callback"), F.lit("filter-off"), F.lit("full")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("mode"), (F.lit(200.0) + F.col("s_suppkey") * 7 + F.col("s_suppkey") % 3 * 11).alias("tok_per_s"))
    o = reports.overhead(t)
    return o.select(*[rounded(F.col(c)).alias(c) for c in ("observability", "readback", "total", "worst_spread")], "conclusive")


OVERHEAD_SQL = """WITH t AS (SELECT ['no-callback', 'filter-off', 'full'][s_suppkey % 3 + 1] AS mode, 200.0::DOUBLE + s_suppkey * 7 + s_suppkey % 3 * 11 AS r FROM supplier),
  m AS (SELECT mode, quantile_cont(r, 0.5) AS med, CASE WHEN count(*) < 2 THEN 0 ELSE (max(r) - min(r)) / 2 / quantile_cont(r, 0.5) END AS spread FROM t GROUP BY mode),
  o AS (SELECT max(med) FILTER (mode = 'no-callback') AS n, max(med) FILTER (mode = 'filter-off') AS f, max(med) FILTER (mode = 'full') AS u, max(spread) AS w FROM m)
  SELECT round(n / f, 9) AS observability, round(f / u, 9) AS readback, round(n / u, 9) AS total, round(w, 9) AS worst_spread, abs(n / u - 1) > 2 * w AS conclusive FROM o"""


def gate_q1(spark, d):
    rates = frame(spark, d, "supplier").select(F.col("s_name").alias("model"), F.when(F.col("s_suppkey") == 1, "scale").when(F.col("s_suppkey") <= 3, "addition").otherwise("primary").alias("role"), (F.lit(80.0) + F.col("s_suppkey") * 9).alias("tok_per_s"))
    g = reports.gate_hours(rates, overhead_ratio=1.25)
    return g.select(rounded(F.col("hours")).alias("hours"), "budget", "passed", rounded(F.col("reduced_hours")).alias("reduced_hours"), "reduced_fits")


GATE_SQL = """WITH h AS (SELECT sum(CASE WHEN s_suppkey = 1 THEN 4000000 ELSE 1000000 END / (80.0::DOUBLE + s_suppkey * 9) * 1.25::DOUBLE / 3600) AS hours FROM supplier)
  SELECT round(hours, 9) AS hours, 18.0::DOUBLE AS budget, hours <= 18 AS passed, round(hours / 2, 9) AS reduced_hours, hours / 2 <= 18 AS reduced_fits FROM h"""

QUERIES = {
    "primary_mean": primary_mean, "primary_per_layer": primary_per_layer, "primary_wide": primary_wide, "primary_depth_bins": primary_depth_bins, "negative_mi_cells": negative_mi_cells,
    "negative_mi_summary": negative_mi_summary, "pair_table": pair_table, "confound_table": confound_table, "shape_ladder": shape_ladder, "shape_depth": shape_depth,
    "verdict_counts": verdict_counts, "reconcile_nearest_depth": reconcile_nearest_depth, "cache_budget": cache_budget, "run_config_conflicts": run_config_conflicts,
    "overhead_ratio": overhead_ratio, "gate_q1": gate_q1,
}
ORACLE_SQL = {
    "primary_mean": PRIMARY_MEAN_SQL, "primary_per_layer": PER_LAYER_SQL, "primary_wide": WIDE_SQL, "primary_depth_bins": DEPTH_SQL, "negative_mi_cells": NEGATIVE_SQL,
    "negative_mi_summary": NEGATIVE_SUMMARY_SQL, "pair_table": PAIR_SQL, "confound_table": CONFOUND_SQL, "shape_ladder": SHAPE_LADDER_SQL, "shape_depth": SHAPE_DEPTH_SQL, "verdict_counts": VERDICT_SQL,
    "reconcile_nearest_depth": RECONCILE_SQL, "cache_budget": CACHE_SQL, "run_config_conflicts": CONFLICTS_SQL, "overhead_ratio": OVERHEAD_SQL, "gate_q1": GATE_SQL,
}
