"""Two traces of the same tokens compared: drift per layer, margins and flips, depth trend, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from .checks import COULD_NOT_RUN, FAILED, PASSED, Refused
from .tables import running

#: Quantiles at which margins are binned, the gate's floor, and the bands of the mean.
MARGIN_QUANTILES = (0.0, 0.05, 0.2, 0.5, 0.8, 1.0)
EQUIVALENCE_FLOOR = 0.999
BOUNDED, SEVERE = 0.97, 0.90


def pair(reference: DataFrame, candidate: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """Rows of both traces by key with the selected sets, their agreement, rank correlation of the
    scores, the reference margin, and whether the set changed."""
    a = reference.select(*key, "layer", F.col("scores").alias("a"))
    b = candidate.select(*key, F.col("scores").alias("b"))
    j = a.join(b, list(key))
    j = j.withColumns({"set_a": arrays.top_m(F.col("a"), k), "set_b": arrays.top_m(F.col("b"), k)})
    return j.select(
        *key, "layer", (arrays.overlap(F.col("set_a"), F.col("set_b")) / k).alias("agreement"),
        arrays.same_set(F.col("set_a"), F.col("set_b")).alias("same_set"), arrays.same_sequence(F.col("set_a"), F.col("set_b")).alias("same_sequence"),
        arrays.spearman(F.col("a"), F.col("b")).alias("spearman"), arrays.margin(F.col("a"), k).alias("margin"),
    )


def per_layer(pairs: DataFrame) -> DataFrame:
    """``layer, n, set_agreement, exact_match, spearman, flip_rate``; the mean correlation is over the
    rows in which it is defined."""
    return pairs.groupBy("layer").agg(
        F.count("*").alias("n"), F.avg("agreement").alias("set_agreement"), F.avg(F.col("same_set").cast("double")).alias("exact_match"),
        F.avg(F.when(~F.isnan("spearman"), F.col("spearman"))).alias("spearman"), F.avg((~F.col("same_set")).cast("double")).alias("flip_rate"),
    )


def margin_edges(pairs: DataFrame, parts: int = 256) -> DataFrame:
    """``layer, edges``: the exact margin quantiles (linear between neighbours), equal ones folded.

    A quantile needs the two values beside its place. Margins are ranked within ``parts`` ranges, whose
    bounds are approximate quantiles, so no task orders or holds a layer's margins.
    """
    rows = pairs.where("margin IS NOT NULL").select("layer", "margin")
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.groupBy("layer").agg(F.percentile_approx("margin", shares, 10 * parts).alias("cuts"), F.count("*").alias("n"))
    rows = rows.join(F.broadcast(cuts), "layer")
    # The first bound that is not below the margin; equal margins are in one range only.
    counted = rows.withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("margin")))).groupBy("layer", "n", "part", "margin").agg(F.count("*").alias("times"))
    ranked = running(counted, ["layer"], F.col("part"), ["margin"], F.col("times"), "before")
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q")) for i, q in enumerate(MARGIN_QUANTILES)])).alias("p")
    wanted = ranked.select("layer", "n", "margin", "before", "times", place).select("*", "p.i", ((F.col("n") - 1) * F.col("p.q")).alias("at"))
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("times"))
    low, high = F.floor("at"), F.ceil("at")
    found = wanted.where(holds(low) | holds(high)).groupBy("layer", "i", "at").agg(F.min("margin").alias("a"), F.max("margin").alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    edges = found.groupBy("layer").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"])).alias("edges"))
    return edges


def margin_bin(margin: Column, edges: Column) -> Column:
    """Number of inner edges at or below the margin: a value on an edge is in the upper bin."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= margin))


def flips_by_margin(pairs: DataFrame) -> DataFrame:
    """``layer, bin, n, flip_rate`` for every bin; a bin without rows has a rate of NaN."""
    edges = margin_edges(pairs)
    spine = edges.select("layer", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    binned = pairs.join(F.broadcast(edges), "layer").withColumn("bin", margin_bin(F.col("margin"), F.col("edges")))
    rates = binned.groupBy("layer", "bin").agg(F.count("*").alias("n"), F.avg((~F.col("same_set")).cast("double")).alias("flip_rate"))
    out = spine.join(rates, ["layer", "bin"], "left")
    return out.select("layer", "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("flip_rate", F.lit(float("nan"))).alias("flip_rate"))


def summary(drift: DataFrame) -> DataFrame:
    """One row: mean agreement over layers, the worst layer (the lowest number where equal), the
    interpretation of the mean, and whether the worst layer passes the gate."""
    out = drift.agg(F.avg("set_agreement").alias("mean_agreement"), F.min(F.struct("set_agreement", "layer")).alias("w"))
    return out.select("mean_agreement", F.col("w.layer").alias("worst_layer"), F.col("w.set_agreement").alias("worst_agreement"), interpretation(F.col("mean_agreement")).alias("interpretation"), (F.col("w.set_agreement") >= EQUIVALENCE_FLOOR).alias("equivalent"))


def interpretation(mean: Column) -> Column:
    """``bounded``, ``moderate`` or ``severe``."""
    return F.when(mean >= BOUNDED, "bounded").when(mean < SEVERE, "severe").otherwise("moderate")


def depth_trend(drift: DataFrame, value: str = "flip_rate") -> DataFrame:
    """Rank correlation of a value with the layer over all layers; NaN under three layers. The window
    spans one row per layer."""
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / F.lit(2.0).cast("double")
    r = drift.select(rank("layer").alias("x"), rank(value).alias("y"))
    corr = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    nan = F.lit(float("nan"))
    return r.agg(F.count("*").alias("n_layers"), F.when(F.count("*") < 3, nan).otherwise(F.coalesce(corr, nan)).alias("trend"))


def gate(drift: DataFrame, varied_a: str | None, varied_b: str | None) -> int:
    """Three-way outcome of the equivalence gate on the worst layer. It cannot run where the field that
    is said to differ is unset on both sides or equal, or without layers."""
    if varied_a == varied_b:
        return COULD_NOT_RUN
    row = summary(drift).first()
    if row["worst_layer"] is None:
        return COULD_NOT_RUN
    return PASSED if row["equivalent"] else FAILED


def require_aligned(alignment: DataFrame) -> None:
    """Refuses traces that differ in positions or tokens, with the first place."""
    r = alignment.first()
    if r["unmatched"] or r["different"]:
        raise Refused(f"traces differ first at document {r['first_doc_id']}, position {r['first_pos']}")
