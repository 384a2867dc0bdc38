"""Information in selections: slot counts, entropies with bias correction, held-out cross-entropy, and
the signed lower bound on mutual information.

A *slot* is one selected expert of one (token, layer); a token contributes k slots. Every table here is
grouped by the caller's ``keys`` and aggregates before its shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import Refused, refuse_if_any

EPSILON = 1e-6
#: A correction above this share of the plug-in value is worth a warning.
CORRECTION_WARNING = 0.01


def slot_counts(slots: DataFrame, keys: Sequence[str], n_experts: int, weight: str | None = None) -> DataFrame:
    """``*keys, expert, n`` with a row for every expert, zero included. ``weight`` names a column that says
    how often a row counts. An expert outside the range fails the query when it runs, in the same pass."""
    checked = F.when((F.col("expert") >= 0) & (F.col("expert") < n_experts), F.col("expert")).otherwise(F.raise_error(F.lit("expert out of range")).cast("int"))
    n = F.sum(weight) if weight else F.count("*")
    counted = slots.select(*keys, checked.alias("expert"), *([weight] if weight else [])).groupBy(*keys, "expert").agg(n.alias("n"))
    # All experts of a group from the map of its counts: the group is read once.
    grouped = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("expert", "n"))).alias("_n"))
    experts = F.explode(F.sequence(F.lit(0), F.lit(n_experts - 1))).alias("expert")
    return grouped.select(*keys, "_n", experts).select(*keys, "expert", F.coalesce(F.try_element_at("_n", F.col("expert")), F.lit(0)).cast("long").alias("n"))


def marginal(counts: DataFrame, keys: Sequence[str], smoothing: float = 0.0) -> DataFrame:
    """``*keys, expert, p``: each expert's share of the slots, with ``smoothing`` added to every count."""
    n = F.col("n") + F.lit(float(smoothing))
    return counts.select(*keys, "expert", (n / F.sum(n).over(Window.partitionBy(*keys))).alias("p"))


def entropies(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, n_slots, bins, plugin, miller_madow`` in bits: plug-in entropy over the bins that
    occur, and with (bins - 1) / (2 N ln 2) added."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    p = F.col("n") / F.col("total")
    seen = counts.withColumn("total", total).where("n > 0")
    out = seen.groupBy(*keys).agg(F.max("total").alias("n_slots"), F.count("*").alias("bins"), F.sum(-p * F.log2(p)).alias("plugin"))
    return out.withColumn("miller_madow", F.col("plugin") + (F.col("bins") - 1) / (2 * F.col("n_slots") * F.lit(math.log(2))))


def load_balance(counts: DataFrame, keys: Sequence[str], n_experts: int) -> DataFrame:
    """``load_balance`` is corrected entropy over log2(n_experts), not clamped; ``correction_warning``
    where the correction passes 1 % of the plug-in value. NaN for a single expert."""
    e = entropies(counts, keys)
    index = F.col("miller_madow") / math.log2(n_experts) if n_experts > 1 else F.lit(float("nan"))
    warn = (F.col("miller_madow") - F.col("plugin")) > CORRECTION_WARNING * F.col("plugin")
    return e.select(*keys, "n_slots", "miller_madow", index.alias("load_balance"), warn.alias("correction_warning"))


def usage(counts: DataFrame, keys: Sequence[str], saturated: float = 4.0) -> DataFrame:
    """``dead``: experts without a slot; ``saturated``: experts with more than ``saturated`` times the
    uniform share, our choice of threshold."""
    uniform = F.sum("n").over(Window.partitionBy(*keys)) / F.count("*").over(Window.partitionBy(*keys))
    c = counts.withColumn("uniform", uniform)
    return c.groupBy(*keys).agg(F.count_if(F.col("n") == 0).alias("dead"), F.count_if(F.col("n") > saturated * F.col("uniform")).alias("saturated"))


def _digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 10, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 10).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 10).any():
        out[small] += 1 / (x[small] * x[small])
        x[small] += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def nsb(counts: np.ndarray, grid: int = 256) -> float:
    """Entropy in bits under a mixture of symmetric Dirichlet priors that is flat in expected entropy:
    the posterior mean at each concentration, weighted by evidence and prior, over a logarithmic grid
    of concentrations. 0 with at most one bin in use."""
    n = np.asarray(counts, float)
    k, total = len(n), n.sum()
    if (n > 0).sum() <= 1:
        return 0.0
    beta = np.logspace(-5, 4, grid) / k
    a = k * beta
    weight = k * _trigamma(a + 1) - _trigamma(beta + 1)
    evidence = _lgamma(a) - _lgamma(a + total)
    sizes, times = np.unique(n[n > 0], return_counts=True)
    for size, m in zip(sizes, times):
        evidence = evidence + m * (_lgamma(beta + size) - _lgamma(beta))
    with np.errstate(divide="ignore"):
        log_weight = evidence + np.log(np.maximum(weight, 0))
    mean = _digamma(a + total + 1)
    sizes, times = np.unique(n, return_counts=True)
    for size, m in zip(sizes, times):
        mean = mean - m * (beta + size) / (a + total) * _digamma(beta + size + 1)
    best = log_weight.max()
    if not np.isfinite(best):
        p = n[n > 0] / total
        return float(-(p * np.log2(p)).sum() + (len(p) - 1) / (2 * total * math.log(2)))
    w = np.exp(log_weight - best)
    norm = np.trapezoid(w, beta)
    return float(np.trapezoid(w * mean, beta) / norm / math.log(2)) if norm > 0 else 0.0


def entropy_nsb(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, nsb``. A group is one histogram, of as many rows as there are experts."""
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "nsb": [nsb(group["n"].to_numpy())]})

    return counts.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "nsb double"]))


ESTIMATORS = ("plugin", "miller_madow", "nsb")


def entropy(counts: DataFrame, keys: Sequence[str], estimator: str = "miller_madow") -> DataFrame:
    """``*keys, entropy_bits`` by one of ESTIMATORS."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; have {ESTIMATORS}")
    if estimator == "nsb":
        return entropy_nsb(counts, keys).withColumnRenamed("nsb", "entropy_bits")
    return entropies(counts, keys).select(*keys, F.col(estimator).alias("entropy_bits"))


def mixed(q: Column, reference: Column, epsilon: float = EPSILON) -> Column:
    """A prediction mixed with a little of the evaluation split's marginal, so no slot has probability 0."""
    return (1 - F.lit(epsilon)) * q + F.lit(epsilon) * reference


def cross_entropy(predicted: DataFrame, keys: Sequence[str], epsilon: float = EPSILON) -> DataFrame:
    """``*keys, n_slots, cross_entropy_bits`` from one row per true slot with the probability ``q``
    predicted for its expert and the marginal ``reference``."""
    bits = -F.log2(mixed(F.col("q"), F.col("reference"), epsilon))
    return predicted.groupBy(*keys).agg(F.count("*").alias("n_slots"), F.avg(bits).alias("cross_entropy_bits"))


def require_distributions(rows: DataFrame, column: str = "q", tolerance: float = 1e-4) -> None:
    """Refuses prediction rows (arrays) that do not sum to 1."""
    total = F.aggregate(column, F.lit(0.0).cast("double"), lambda a, x: a + x)
    refuse_if_any(rows.where(F.abs(total - 1) > tolerance).select(total.alias("sum")), "a prediction row does not sum to 1")


def mutual_information(entropy_: DataFrame, ce: DataFrame, keys: Sequence[str], n_experts: int) -> DataFrame:
    """The signed bound H - CE with its companions. A negative value is a result and stays. Where H is
    0 the ratios are NaN, as is what is divided by log2 of one expert."""
    both = entropy_.join(ce, list(keys))
    h, c = F.col("entropy_bits"), F.col("cross_entropy_bits")
    top = math.log2(n_experts) if n_experts > 1 else float("nan")
    nan = F.lit(float("nan"))
    return both.select(
        *keys, "n_slots", "entropy_bits", "cross_entropy_bits", (h - c).alias("mi_bits"),
        F.when(h == 0, nan).otherwise((h - c) / F.when(h == 0, F.lit(1.0)).otherwise(h)).alias("ratio"),
        (c / F.lit(top)).alias("ce_normalized"), (h / F.lit(top)).alias("entropy_normalized"), (h < c).alias("negative"),
    )


def require_same_split(entropy_split: str, ce_split: str) -> None:
    """Entropy and cross-entropy of different splits do not subtract."""
    if entropy_split != ce_split:
        raise Refused(f"entropy is of {entropy_split!r}, cross-entropy of {ce_split!r}")
