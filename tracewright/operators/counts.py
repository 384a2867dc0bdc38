"""Count-table predictors: the marginal (F0), token identity (F1), and frequency strata.

The table is sparse, one row per (token, expert) that occurs; the prior fills the rest. Everything is
closed form, so fitting is one aggregation and scoring is two joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .information import marginal, slot_counts
from .tables import running

#: The smoothing grid, in the order in which ties are resolved.
ALPHAS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)


def cells(slots: DataFrame, keys: Sequence[str], token: str = "token_id") -> DataFrame:
    """``*keys, token, expert, times``: the one pass over the slots. What follows takes these rows, at most
    experts times vocabulary of them per key."""
    return slots.groupBy(*keys, token, "expert").agg(F.count("*").alias("times"))


def count_table(train: DataFrame, keys: Sequence[str], token: str = "token_id") -> DataFrame:
    """``*keys, token, expert, n, row_n`` of cells: slots per token and expert, and per token."""
    row_n = F.sum("times").over(Window.partitionBy(*keys, token))
    return train.select(*keys, token, "expert", F.col("times").alias("n"), row_n.alias("row_n"))


def _scored(true: DataFrame, train: DataFrame, keys: Sequence[str], n_experts: int, token: str) -> DataFrame:
    """Each true cell with its train count, row count and prior (add-one marginal of train); a token that
    train lacks has counts of 0."""
    prior = marginal(slot_counts(train, keys, n_experts, "times"), keys, smoothing=1.0).withColumnRenamed("p", "prior")
    counts_ = train.select(*keys, token, "expert", F.col("times").alias("n"))
    rows = train.groupBy(*keys, token).agg(F.sum("times").alias("row_n"))
    out = true.join(prior, [*keys, "expert"]).join(counts_, [*keys, token, "expert"], "left").join(rows, [*keys, token], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "row_n": F.coalesce("row_n", F.lit(0))})


def _reference(true: DataFrame, keys: Sequence[str], n_experts: int) -> DataFrame:
    return marginal(slot_counts(true, keys, n_experts, "times"), keys).withColumnRenamed("p", "reference")


def f0(train: DataFrame, test: DataFrame, keys: Sequence[str], n_experts: int) -> DataFrame:
    """``*keys, n_slots, cross_entropy_bits`` of the smoothed train marginal on test cells."""
    q = marginal(slot_counts(train, keys, n_experts, "times"), keys, smoothing=1.0).withColumnRenamed("p", "q")
    true = test.groupBy(*keys, "expert").agg(F.sum("times").alias("times"))
    rows = true.join(q, [*keys, "expert"]).join(_reference(test, keys, n_experts), [*keys, "expert"])
    return _weighted(rows, keys)


def _weighted(rows: DataFrame, keys: Sequence[str], epsilon: float = 1e-6) -> DataFrame:
    bits = -F.log2((1 - F.lit(epsilon)) * F.col("q") + F.lit(epsilon) * F.col("reference"))
    return rows.groupBy(*keys).agg(F.sum("times").alias("n_slots"), (F.sum(F.col("times") * bits) / F.sum("times")).alias("cross_entropy_bits"))


def alpha_grid(train: DataFrame, val: DataFrame, keys: Sequence[str], n_experts: int, top_k: int, token: str = "token_id") -> DataFrame:
    """``*keys, alpha, place, cross_entropy_bits`` of F1 on the validation split for every alpha."""
    scored = _scored(val, train, keys, n_experts, token).join(_reference(val, keys, n_experts), [*keys, "expert"])
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(i).alias("place")) for i, a in enumerate(ALPHAS)]))
    scored = scored.withColumn("g", grid).select("*", "g.alpha", "g.place")
    scored = scored.withColumn("q", _probability(F.col("alpha"), top_k))
    return _weighted(scored, [*keys, "alpha", "place"]).drop("n_slots")


def _probability(alpha, top_k: int):
    strength = alpha * F.lit(float(top_k))
    return (F.col("n") + strength * F.col("prior")) / (F.col("row_n") + strength)


def best_alpha(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, alpha``: the least cross-entropy, the first of the grid where equal."""
    return grid.groupBy(*keys).agg(F.min(F.struct("cross_entropy_bits", "place", "alpha")).alias("m")).select(*keys, "m.alpha")


def f1(train: DataFrame, test: DataFrame, alpha: DataFrame, keys: Sequence[str], n_experts: int, top_k: int, token: str = "token_id") -> DataFrame:
    """Cells of test with ``q`` and ``reference``, ``times`` each, for ``_weighted`` or strata."""
    rows = _scored(test, train, keys, n_experts, token).join(_reference(test, keys, n_experts), [*keys, "expert"])
    return rows.join(F.broadcast(alpha), list(keys)).withColumn("q", _probability(F.col("alpha"), top_k))


def f1_cross_entropy(train: DataFrame, test: DataFrame, alpha: DataFrame, keys: Sequence[str], n_experts: int, top_k: int, token: str = "token_id") -> DataFrame:
    return _weighted(f1(train, test, alpha, keys, n_experts, top_k, token), keys)


def frequency_buckets(tokens: DataFrame, buckets: int = 10, token: str = "token_id") -> DataFrame:
    """``token, bucket``: token types by frequency (then token) in equal parts, the larger parts first.

    The order is cut by frequency and the token's leading part, so that no task orders the vocabulary and
    not even the many tokens that occur once."""
    types = tokens.groupBy(token).agg(F.count("*").alias("freq"))
    lead = F.substring(token, 1, 3) if dict(types.dtypes)[token] == "string" else F.floor(F.col(token) / 65536)
    ranked = running(types.withColumn("_all", F.lit(0)), ["_all"], F.struct(F.col("freq"), lead.alias("lead")), ["freq", token], F.lit(1), "rank")
    total = types.agg(F.count("*").alias("total"))
    size, larger = F.floor(F.col("total") / buckets), F.col("total") % buckets
    early = larger * (size + 1)
    bucket = F.when(F.col("rank") < early, F.floor(F.col("rank") / (size + 1))).otherwise(larger + F.floor(F.try_divide(F.col("rank") - early, size)))
    return ranked.join(F.broadcast(total), F.lit(True)).select(token, bucket.cast("int").alias("bucket"))


def strata(rows: DataFrame, buckets: DataFrame, keys: Sequence[str], token: str = "token_id") -> DataFrame:
    """``*keys, bucket, n_slots, cross_entropy_bits``; tokens without a bucket are in bucket -1."""
    joined = rows.join(buckets, token, "left").withColumn("bucket", F.coalesce("bucket", F.lit(-1)))
    return _weighted(joined, [*keys, "bucket"])


__all__ = ["ALPHAS", "alpha_grid", "best_alpha", "cells", "count_table", "f0", "f1", "f1_cross_entropy", "frequency_buckets", "strata"]
