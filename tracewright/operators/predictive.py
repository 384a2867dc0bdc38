"""Set overlap between predicted and true selections, and repetition along a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays


def budgets(k: int, n_experts: int) -> list[int]:
    """k, 2k and 4k, capped at the number of experts, each once."""
    return sorted({min(m, n_experts) for m in (k, 2 * k, 4 * k)})


def recall_curve(rows: DataFrame, keys: Sequence[str], k: int, n_experts: int, scores: str = "scores", truth: str = "truth") -> DataFrame:
    """``*keys, m, n, recall`` for each budget m: the mean share of the true set among the m highest
    scores. ``set_agreement`` is the recall at k, ``exact_match`` the share of equal sets."""
    ranked = rows.withColumn("_ranked", arrays.ranked(F.col(scores)))
    at = [F.avg(arrays.overlap(F.slice("_ranked", 1, m), F.col(truth)) / k).alias(f"m{m}") for m in budgets(k, n_experts)]
    exact = F.avg(arrays.same_set(F.slice("_ranked", 1, k), F.col(truth)).cast("double")).alias("exact_match")
    wide = ranked.groupBy(*keys).agg(F.count("*").alias("n"), exact, *at)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"m{m}").alias("recall")) for m in budgets(k, n_experts)]))
    return wide.select(*keys, "n", "exact_match", pairs.alias("x")).select(*keys, "n", "exact_match", "x.m", "x.recall")


def repetition(slots: DataFrame, k: int, n_experts: int, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """How much of a token's set the next token of its document selects again.

    Per key: ``n_rows`` tokens with a predecessor, ``excluded`` document-initial ones, the mean overlap
    share, the share of equal sets, and the chance level k / n_experts. The expert sets are matched by
    a lag over the document's positions, one row per slot and predecessor.
    """
    # Dealt by document at once: the grouping and the lag below both find their rows together.
    slots = slots.select(*keys, "doc_id", "pos", "expert").repartition(*keys, "doc_id")
    sets = slots.groupBy(*keys, "doc_id", "pos").agg(F.sort_array(F.collect_list("expert")).alias("experts"))
    w = Window.partitionBy(*keys, "doc_id").orderBy("pos")
    pairs = sets.withColumns({"before": F.lag("experts").over(w), "pos_before": F.lag("pos").over(w)})
    has = F.coalesce(F.col("pos_before") == F.col("pos") - 1, F.lit(False))
    share = F.when(has, F.size(F.array_intersect("experts", "before")) / k)
    equal = F.when(has, (F.col("experts") == F.col("before")).cast("double"))
    return pairs.groupBy(*keys).agg(
        F.count_if(has).alias("n_rows"), F.count_if(~has).alias("excluded"), F.avg(share).alias("repetition_rate"),
        F.avg(equal).alias("exact_repeat_rate"), F.lit(k / n_experts).alias("chance"),
    )


def exclusions(rows: DataFrame, feature: str, first_layer: int = 0) -> DataFrame:
    """``layer, feature, kept, excluded, reason`` for features that need the layer below (F2) or the
    token before (F3); ``rows`` has one row per (doc, pos, layer)."""
    if feature == "F2":
        lost, reason = F.col("layer") == first_layer, "no layer below"
    elif feature == "F3":
        lost, reason = F.col("pos") == 0, "first token of its document"
    else:
        raise ValueError(f"{feature} excludes no rows by itself")
    out = rows.groupBy("layer").agg(F.count_if(~lost).alias("kept"), F.count_if(lost).alias("excluded"))
    return out.select("layer", F.lit(feature).alias("feature"), "kept", "excluded", F.when(F.col("excluded") > 0, reason).alias("reason"))
