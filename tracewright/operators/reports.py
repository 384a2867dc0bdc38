"""Report tables over result cells, in which a missing value is never a number.

A *cell* is one (model, feature, layer) with metric columns. ``grid`` lays the expected cells of the
panel out and gives each a ``value`` or a ``missing`` kind, exactly one of them: ``feature_absent``,
``not_reached``, ``skipped``, ``metric_absent``. NaN is a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import Refused

#: The ladder of features and the verdicts.
LADDER = ("F0", "F1", "F2", "F4")
VERDICTS = ("agrees", "mixed", "disagrees", "not_evaluable")
#: Published first-choice repetition (name, layer, layers, low, high, chance), for one model.
FIGURES = (
    ("first_choice_layer0", 0, 32, 0.136, 0.149, 0.125),
    ("first_choice_layer15", 15, 32, 0.236, 0.284, 0.125),
    ("first_choice_layer31", 31, 32, 0.197, 0.263, 0.125),
    ("first_or_second_choice_layer15", 15, 32, 0.616, 0.670, None),
)

#: Choices of definition that part a published figure from a measured one: axis, published side, measured side.
AXES = (
    ("first_choice_or_set", "the first choice alone, or membership in a set of two", "share of the whole set of k that returns"),
    ("chance", "one over the number of experts", "k over the number of experts, so only the excess is comparable between models"),
    ("layers", "per layer for repetition, pooled over layers for caches", "per layer, brought together on normalised depth only"),
    ("capacity_or_step", "hits of a cache of some capacity over a whole run", "one step: repetition, or recall at k, 2k and 4k places"),
    ("counted_or_fitted", "counted, nothing is fitted", "counted for repetition, fitted for the features"),
)


def depth(layer: Column, n_layers: Column) -> Column:
    """Layer over the last layer; 0 for a single layer."""
    return F.when(n_layers <= 1, F.lit(0.0)).otherwise(F.try_divide(layer.cast("double"), (n_layers - 1).cast("double")))


def depth_bin(depth_: Column, bins: int) -> Column:
    """Number of the equal-width bin; the last one is closed."""
    return F.least(F.floor(depth_ * bins).cast("int"), F.lit(bins - 1))


def bin_label(number: Column, bins: int) -> Column:
    close = F.when(number == bins - 1, "]").otherwise(")")
    return F.concat(F.format_string("[%.2f,%.2f", number / F.lit(float(bins)), (number + 1) / F.lit(float(bins))), close)


def recall_key(m: int, top_k: Column) -> Column:
    """Key of the recall at m times k in a metric map."""
    return F.concat(F.lit("recall@"), (top_k * m).cast("string"))


def require_models(panel: DataFrame, wanted: Sequence[str]) -> None:
    lost = set(wanted) - {r["model"] for r in panel.select("model").collect()}
    if lost:
        raise Refused(f"no results for {sorted(lost)}")


def grid(panel: DataFrame, cells: DataFrame, metric: Column, features: Sequence[str] | None = None) -> DataFrame:
    """``model, n_moe_layers, n_experts, top_k, feature, layer, value, missing`` for every expected cell:
    models by layers by the features that any model has. The spine is as small as the report."""
    have = cells.select("feature").distinct() if features is None else cells.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    spine = panel.select("model", "n_moe_layers", "n_experts", "top_k", F.explode(F.sequence(F.lit(0), F.col("n_moe_layers") - 1)).alias("layer")).join(F.broadcast(have), F.lit(True))
    absent = cells.select("model", "feature").distinct().withColumn("present", F.lit(True))
    values = cells.select("model", "feature", "layer", "status", metric.alias("value"))
    out = spine.join(absent, ["model", "feature"], "left").join(values, ["model", "feature", "layer"], "left")
    missing = F.when(F.col("present").isNull(), "feature_absent").when(F.col("status").isNull(), "not_reached").when(F.col("status") == "skipped", "skipped").when(F.col("value").isNull(), "metric_absent")
    return out.select("model", "n_moe_layers", "n_experts", "top_k", "feature", "layer", F.when(missing.isNull(), F.col("value")).alias("value"), missing.alias("missing"))


def primary_mean(g: DataFrame) -> DataFrame:
    """Mean over the layers that have a value, with how many were used of how many expected and the
    kinds of the holes; no value at all is ``no_layers``."""
    out = g.groupBy("model", "feature").agg(F.avg("value").alias("value"), F.count("value").alias("n_used"), F.count("*").alias("n_expected"), F.array_join(F.sort_array(F.collect_set("missing")), ",").alias("holes"))
    return out.withColumn("missing", F.when(F.col("n_used") == 0, "no_layers"))


def primary_depth(g: DataFrame, bins: int = 5) -> DataFrame:
    """Mean per bin of normalised depth, every bin listed; an empty one is ``no_layers``."""
    d = g.withColumn("bin", depth_bin(depth(F.col("layer"), F.col("n_moe_layers")), bins))
    spine = g.select("model", "feature").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    means = d.groupBy("model", "feature", "bin").agg(F.avg("value").alias("value"), F.countDistinct("layer").alias("n_layers"))
    out = spine.join(means, ["model", "feature", "bin"], "left")
    return out.select("model", "feature", "bin", bin_label(F.col("bin"), bins).alias("label"), F.coalesce("n_layers", F.lit(0)).alias("n_layers"), "value", F.when(F.col("value").isNull(), "no_layers").alias("missing"))


def pivoted(rows: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Features as columns."""
    return rows.groupBy(*keys).pivot("feature", list(features)).agg(F.first("value"))


def negative_cells(cells: DataFrame) -> DataFrame:
    """Cells whose signed bound is below zero, as measured. NaN is not below zero."""
    return cells.where((F.col("status") == "ok") & ~F.isnan("mi_bits") & (F.col("mi_bits") < 0))


def negative_summary(g: DataFrame) -> DataFrame:
    """``model, feature, negative, examined, missing`` from a grid of the signed bound."""
    below = (F.col("value") < 0) & ~F.isnan("value")
    return g.groupBy("model", "feature").agg(F.count_if(below).alias("negative"), F.count("value").alias("examined"), F.count("missing").alias("missing"))


def pair_table(rows: DataFrame, axis: Sequence[str], a: str, b: str) -> DataFrame:
    """Two models side by side by axis and feature with the difference b - a; null where either side is
    missing, and both sides keep their kind of hole."""
    two = rows.where(F.col("model").isin(a, b))
    side = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    out = two.groupBy(*axis, "feature").agg(side(a, "value").alias("a"), side(b, "value").alias("b"), side(a, "missing").alias("missing_a"), side(b, "missing").alias("missing_b"))
    return out.withColumn("delta", F.col("b") - F.col("a"))


def framed(pairs: DataFrame, name: str, holds_fixed: Sequence[str], not_matched: Sequence[str], framing: str) -> DataFrame:
    """``pair_table`` with what the pair holds fixed, what it does not match and how it may be read as
    columns, so that a row that is copied keeps them. A pair without framing is refused."""
    if not framing.strip():
        raise Refused(f"pair {name} has no framing")
    lists = lambda items: F.array(*map(F.lit, items)).cast("array<string>")
    return pairs.select(F.lit(name).alias("pair"), "*", lists(holds_fixed).alias("holds_fixed"), lists(not_matched).alias("not_matched"), F.lit(framing).alias("framing"))


def confounds(panel: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured load balance (mean over ``measured(model, load_balance)``) and the declared auxiliary loss,
    side by side and never one for the other; ``density`` is k over experts."""
    m = measured.groupBy("model").agg(F.avg("load_balance").alias("load_balance"), F.count("load_balance").alias("n_layers"))
    out = panel.join(F.broadcast(m), "model", "left")
    return out.select("model", "n_moe_layers", "n_experts", "top_k", (F.col("top_k") / F.col("n_experts")).alias("density"), "aux_loss", "load_balance", F.coalesce("n_layers", F.lit(0)).alias("n_layers_measured"))


def ladder(g: DataFrame, steps: Sequence[str] = LADDER, tolerance: float = 0.0) -> DataFrame:
    """Per model: on how many layers the metric does not fall along the ladder's features that the model
    has, of those where all have a value, and the verdict."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(steps) for x in (s, i)])
    r = g.where(F.col("feature").isin(*steps) & ~F.coalesce(F.col("missing") == "feature_absent", F.lit(False))).withColumn("place", place[F.col("feature")])
    r = r.withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy("model", "layer").orderBy("place")))
    layers = r.groupBy("model", "layer").agg(F.count("*").alias("present"), F.count("value").alias("valued"), F.bool_and(F.coalesce(F.col("step") >= -tolerance, F.lit(True))).alias("ordered"))
    usable = (F.col("valued") == F.col("present")) & (F.col("present") >= 2)
    out = layers.groupBy("model").agg(F.count_if(usable).alias("n_layers"), F.count_if(usable & F.col("ordered")).alias("n_ordered"))
    verdict = F.when(F.col("n_layers") == 0, "not_evaluable").when(F.col("n_ordered") == F.col("n_layers"), "agrees").when(F.col("n_ordered") == 0, "disagrees").otherwise("mixed")
    return out.withColumn("verdict", verdict)


def depth_shape(g: DataFrame, flat: float = 1e-3) -> DataFrame:
    """Per model: spread over depth, peak and trough (the first layer where equal) and the verdict: flat
    disagrees, a peak inside that is above both ends agrees, else mixed; under three layers not evaluable."""
    r = g.where("value IS NOT NULL").withColumn("depth", depth(F.col("layer"), F.col("n_moe_layers")))
    out = r.groupBy("model").agg(
        F.count("*").alias("n_layers"), (F.max("value") - F.min("value")).alias("spread"),
        F.min(F.struct((-F.col("value")).alias("minus"), "layer", "depth")).alias("top"), F.min(F.struct("value", "layer")).alias("low"),
        F.min_by("value", "layer").alias("first"), F.max_by("value", "layer").alias("last"),
    )
    inside = (F.col("top.depth") > 0) & (F.col("top.depth") < 1) & (-F.col("top.minus") - F.greatest("first", "last") > flat)
    verdict = F.when(F.col("n_layers") < 3, "not_evaluable").when(F.col("spread") <= flat, "disagrees").when(inside, "agrees").otherwise("mixed")
    return out.select("model", "n_layers", "spread", F.col("top.layer").alias("peak_layer"), F.col("low.layer").alias("trough_layer"), verdict.alias("verdict"))


def verdict_histogram(rows: DataFrame) -> DataFrame:
    """``verdict, n`` for every verdict."""
    spine = rows.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return spine.join(rows.groupBy("verdict").agg(F.count("*").alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


def figures(spark) -> DataFrame:
    return spark.createDataFrame(list(FIGURES), "figure string, fig_layer int, fig_layers int, low double, high double, chance double")


def axes(spark) -> DataFrame:
    return spark.createDataFrame(list(AXES), "axis string, published string, measured string")


def cache_budget(panel: DataFrame, curves: DataFrame) -> DataFrame:
    """``model, layer, m, share, recall``: for every layer of every model, what part of the true set a cache of
    m places would have held, where m is k, 2k and 4k of that model, at most all experts, and ``share`` is m
    over the experts. ``curves(model, layer, m, recall)`` are folded into one metric map a layer, which is read by
    keys that follow the model's k; without a curve or without that budget the recall is null."""
    maps = curves.groupBy("model", "layer").agg(F.map_from_entries(F.collect_list(F.struct(recall_key(1, F.col("m")), "recall"))).alias("metrics"))
    places = F.array_distinct(F.array(*[F.least(F.col("top_k") * times, F.col("n_experts")) for times in (1, 2, 4)]))
    spine = panel.withColumn("layer", F.explode(F.sequence(F.lit(0), F.col("n_moe_layers") - 1))).join(maps, ["model", "layer"], "left")
    spine = spine.withColumn("m", F.explode(places))
    return spine.select("model", "layer", "m", (F.col("m") / F.col("n_experts")).alias("share"), F.try_element_at("metrics", recall_key(1, F.col("m"))).alias("recall"))


def nearest_depth(figures_: DataFrame, points: DataFrame) -> DataFrame:
    """Each figure beside the layer of each model that is nearest in normalised depth, the lower layer
    where equal. ``points(model, n_moe_layers, layer, ...)`` has a row per model and layer and the figures
    are a handful, so every pair is looked at."""
    target = depth(F.col("fig_layer"), F.col("fig_layers"))
    j = points.join(F.broadcast(figures_), F.lit(True)).withColumn("error", F.abs(depth(F.col("layer"), F.col("n_moe_layers")) - target))
    best = Window.partitionBy("figure", "model").orderBy("error", "layer")
    return j.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def overhead(timings: DataFrame) -> DataFrame:
    """One row from ``mode, tok_per_s``: ratios of time between capture modes and whether the total effect
    exceeds twice the worst half-range of the repeats."""
    m = timings.groupBy("mode").agg(F.percentile("tok_per_s", 0.5).alias("median"), ((F.max("tok_per_s") - F.min("tok_per_s")) / 2).alias("half"), F.count("*").alias("n"))
    m = m.withColumn("spread", F.when((F.col("n") < 2) | (F.col("median") == 0), 0.0).otherwise(F.try_divide("half", "median")))
    of = lambda mode: F.max(F.when(F.col("mode") == mode, F.col("median")))
    nan = F.lit(float("nan"))
    ratio = lambda top, base: F.coalesce(F.when(of(top) > 0, F.try_divide(of(base), of(top))), nan)
    out = m.agg(ratio("filter-off", "no-callback").alias("observability"), ratio("full", "filter-off").alias("readback"), ratio("full", "no-callback").alias("total"), F.max("spread").alias("worst_spread"))
    return out.withColumn("conclusive", ~F.isnan("total") & (F.abs(F.col("total") - 1) > 2 * F.col("worst_spread")))


def gate_hours(rates: DataFrame, overhead_ratio: float, weekly: float = 30.0, fraction: float = 0.60, tokens: int = 1_000_000, scale_tokens: int = 4_000_000) -> DataFrame:
    """One row from ``model, role, tok_per_s`` (roles primary, addition, scale): projected GPU hours, the
    budget, whether it holds, and the hours after halving the tokens."""
    hours = F.when(F.col("role") == "scale", F.lit(scale_tokens)).otherwise(F.lit(tokens)) / F.col("tok_per_s") * overhead_ratio / 3600
    bad = rates.where("tok_per_s IS NULL OR tok_per_s <= 0").take(1)
    if bad or overhead_ratio <= 0:
        raise Refused(f"no measured throughput: {bad}")
    out = rates.agg(F.sum(hours).alias("hours"))
    budget = weekly * fraction
    return out.select("hours", F.lit(budget).alias("budget"), (F.col("hours") <= budget).alias("passed"), (F.col("hours") / 2).alias("reduced_hours"), (F.col("hours") / 2 <= budget).alias("reduced_fits"))
