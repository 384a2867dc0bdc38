"""Queries over the derived trace: counts, entropies, predictors on counts, repetition, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import counts, information, predictive, validation
from ..operators.checks import rounded
from ..operators.tables import kept
from .views import N_EXPERTS, N_LAYERS, TOP_K, frame, with_views

LAYER = ["layer"]
_SPINE = "SELECT CAST(x AS INT) AS expert FROM (SELECT unnest(range(16)) AS x)"


def _slots(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    slots = frame(spark, d, "slots")
    if split is None:
        return slots
    chosen = frame(spark, d, "doc_splits").where(F.col("split") == split).select("doc_id")
    return slots.join(chosen, "doc_id", "left_semi")


def repetition_by_layer(spark, d):
    r = predictive.repetition(frame(spark, d, "slots"), TOP_K, N_EXPERTS)
    return r.select("layer", "n_rows", "excluded", rounded(F.col("repetition_rate")).alias("repetition_rate"), rounded(F.col("exact_repeat_rate")).alias("exact_repeat_rate"), "chance")


REPETITION_SQL = with_views(
    """WITH per AS (
         SELECT a.layer, a.doc_id, a.pos, count(b.expert) AS shared
         FROM slots a LEFT JOIN slots b ON b.layer = a.layer AND b.doc_id = a.doc_id AND b.pos = a.pos - 1 AND b.expert = a.expert
         GROUP BY ALL)
       SELECT layer, count(*) FILTER (pos > 0) AS n_rows, count(*) FILTER (pos = 0) AS excluded,
         round(avg(shared / 4.0::DOUBLE) FILTER (pos > 0), 9) AS repetition_rate,
         round(avg(CASE WHEN shared = 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (pos > 0), 9) AS exact_repeat_rate, 0.25::DOUBLE AS chance
       FROM per GROUP BY layer""",
    "slots",
)


def event_repetition(spark, d):
    t = frame(spark, d, "event_tokens")
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = t.withColumn("same", F.col("token") == F.lag("token").over(w))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.count_if("same").alias("repeats"))


EVENT_REPETITION_SQL = with_views(
    """SELECT a.token, count(*) AS n, count(b.token) AS repeats
       FROM event_tokens a LEFT JOIN event_tokens b ON b.doc_id = a.doc_id AND b.pos = a.pos - 1 AND b.token = a.token GROUP BY a.token""",
    "event_tokens",
)


def slot_counts_zero_filled(spark, d):
    return information.slot_counts(_slots(spark, d), LAYER, N_EXPERTS)


SLOT_COUNTS_SQL = with_views(
    f"""SELECT l.layer, e.expert, count(s.expert) AS n
        FROM (SELECT DISTINCT layer FROM slots) l CROSS JOIN ({_SPINE}) e LEFT JOIN slots s ON s.layer = l.layer AND s.expert = e.expert
        GROUP BY ALL""",
    "slots",
)


def marginal_by_split(spark, d):
    slots = frame(spark, d, "slots").join(frame(spark, d, "doc_splits"), "doc_id")
    c = information.slot_counts(slots, ["split", "layer"], N_EXPERTS)
    return information.marginal(c, ["split", "layer"]).select("split", "layer", "expert", rounded(F.col("p")).alias("p"))


MARGINAL_SQL = with_views(
    f"""SELECT g.split, g.layer, e.expert, round(count(s.expert) / any_value(g.total)::DOUBLE, 9) AS p
        FROM (SELECT split, layer, count(*) AS total FROM slots JOIN doc_splits USING (doc_id) GROUP BY ALL) g CROSS JOIN ({_SPINE}) e
        LEFT JOIN (SELECT split, layer, expert FROM slots JOIN doc_splits USING (doc_id)) s
          ON s.split = g.split AND s.layer = g.layer AND s.expert = e.expert
        GROUP BY ALL""",
    "slots", "doc_splits",
)


def _entropy_frame(spark, d):
    c = information.slot_counts(_slots(spark, d), LAYER, N_EXPERTS)
    return information.entropies(c, LAYER)


def entropy_plugin_mm(spark, d):
    e = _entropy_frame(spark, d)
    return e.select("layer", "n_slots", "bins", rounded(F.col("plugin")).alias("plugin"), rounded(F.col("miller_madow")).alias("miller_madow"))


_ENTROPY = """c AS (SELECT layer, expert, count(*) AS n FROM slots GROUP BY ALL),
       t AS (SELECT *, sum(n) OVER (PARTITION BY layer) AS total FROM c),
       e AS (SELECT layer, CAST(max(total) AS BIGINT) AS n_slots, count(*) AS bins, sum(-(n / total::DOUBLE) * log2(n / total::DOUBLE)) AS plugin FROM t GROUP BY layer)"""
ENTROPY_SQL = with_views(
    f"""WITH {_ENTROPY}
       SELECT layer, n_slots, bins, round(plugin, 9) AS plugin, round(plugin + (bins - 1) / (2 * n_slots * ln(2)), 9) AS miller_madow FROM e""",
    "slots",
)


def entropy_nsb(spark, d):
    c = information.slot_counts(_slots(spark, d), LAYER, N_EXPERTS)
    return information.entropy_nsb(c, LAYER).select("layer", rounded(F.col("nsb"), 6).alias("nsb"))


def load_balance_index(spark, d):
    c = information.slot_counts(_slots(spark, d), LAYER, N_EXPERTS)
    b = information.load_balance(c, LAYER, N_EXPERTS)
    return b.select("layer", "n_slots", rounded(F.col("load_balance")).alias("load_balance"), "correction_warning")


LOAD_BALANCE_SQL = with_views(
    f"""WITH {_ENTROPY}
       SELECT layer, n_slots, round((plugin + (bins - 1) / (2 * n_slots * ln(2))) / 4.0::DOUBLE, 9) AS load_balance,
         (bins - 1) / (2 * n_slots * ln(2)) > 0.01 * plugin AS correction_warning FROM e""",
    "slots",
)


def dead_saturated_experts(spark, d):
    c = information.slot_counts(_slots(spark, d), LAYER, N_EXPERTS)
    return information.usage(c, LAYER, saturated=1.1)


DEAD_SQL = with_views(
    f"""WITH s AS (SELECT * FROM slots),
         c AS (SELECT l.layer, e.expert, count(s.expert) AS n FROM (SELECT DISTINCT layer FROM s) l CROSS JOIN ({_SPINE}) e
               LEFT JOIN s ON s.layer = l.layer AND s.expert = e.expert GROUP BY ALL),
         u AS (SELECT *, sum(n) OVER (PARTITION BY layer) / 16.0::DOUBLE AS uniform FROM c)
       SELECT layer, count(*) FILTER (n = 0) AS dead, count(*) FILTER (n > 1.1::DOUBLE * uniform) AS saturated FROM u GROUP BY layer""",
    "slots",
)


def split_coverage_gaps(spark, d):
    """Documents of the trace that no split covers, here those left out of an incomplete split table."""
    splits = frame(spark, d, "doc_splits").where("doc_id % 7 <> 0")
    return validation.split_gaps(frame(spark, d, "tokens"), splits)


SPLIT_GAPS_SQL = with_views(
    "SELECT doc_id, count(*) AS n_tokens FROM tokens WHERE doc_id NOT IN (SELECT doc_id FROM doc_splits WHERE doc_id % 7 <> 0) GROUP BY doc_id",
    "tokens", "doc_splits",
)


def _splits(spark, d):
    """Cells of each split, from one checkpointed pass over the slots."""
    slots = frame(spark, d, "slots").join(frame(spark, d, "doc_splits"), "doc_id")
    all_ = kept(counts.cells(slots, ["split", *LAYER]))
    return tuple(all_.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))


def _mi(test: DataFrame, ce: DataFrame) -> DataFrame:
    h = information.entropy(information.slot_counts(test, LAYER, N_EXPERTS, "times"), LAYER)
    m = information.mutual_information(h, ce, LAYER, N_EXPERTS)
    names = ("entropy_bits", "cross_entropy_bits", "mi_bits", "ratio", "ce_normalized", "entropy_normalized")
    # The bound's last digits are differences of near-equal sums; six places are compared.
    return m.select("layer", "n_slots", *[rounded(F.col(c), 6).alias(c) for c in names])


def f0_marginal_eval(spark, d):
    train, _, test = _splits(spark, d)
    return _mi(test, counts.f0(train, test, LAYER, N_EXPERTS))


_SPLIT_CTES = f"""st AS (SELECT s.layer, s.doc_id, s.pos, s.token_id, s.expert, d.split FROM slots s JOIN doc_splits d USING (doc_id)),
  spine AS (SELECT l.layer, e.expert FROM (SELECT DISTINCT layer FROM st) l CROSS JOIN ({_SPINE}) e),
  prior AS (SELECT layer, expert, (n + 1) / sum(n + 1) OVER (PARTITION BY layer)::DOUBLE AS p FROM (
      SELECT spine.layer, spine.expert, count(st.expert) AS n FROM spine LEFT JOIN st ON st.layer = spine.layer AND st.expert = spine.expert AND st.split = 'train' GROUP BY ALL)),
  ref AS (SELECT split, layer, expert, n / sum(n) OVER (PARTITION BY split, layer)::DOUBLE AS p FROM (SELECT split, layer, expert, count(*) AS n FROM st GROUP BY ALL)),
  h AS (SELECT layer, sum(-p * log2(p)) + (count(*) - 1) / (2 * any_value(total) * ln(2)) AS h FROM (
      SELECT layer, n / sum(n) OVER (PARTITION BY layer)::DOUBLE AS p, sum(n) OVER (PARTITION BY layer) AS total FROM (
        SELECT layer, expert, count(*) AS n FROM st WHERE split = 'test' GROUP BY ALL)) GROUP BY layer)"""
_MI_SELECT = """SELECT ce.layer, n_slots, round(h, 6) AS entropy_bits, round(ce, 6) AS cross_entropy_bits, round(h - ce, 6) AS mi_bits,
  round((h - ce) / h, 6) AS ratio, round(ce / 4.0::DOUBLE, 6) AS ce_normalized, round(h / 4.0::DOUBLE, 6) AS entropy_normalized
  FROM ce JOIN h ON h.layer = ce.layer"""
F0_SQL = with_views(
    f"""WITH {_SPLIT_CTES},
  ce AS (SELECT st.layer, count(*) AS n_slots, avg(-log2((1 - 1e-6::DOUBLE) * prior.p + 1e-6::DOUBLE * ref.p)) AS ce
    FROM st JOIN prior ON prior.layer = st.layer AND prior.expert = st.expert
    JOIN ref ON ref.split = 'test' AND ref.layer = st.layer AND ref.expert = st.expert WHERE st.split = 'test' GROUP BY st.layer)
  {_MI_SELECT}""",
    "slots", "doc_splits",
)


def f1_count_table(spark, d):
    return counts.count_table(counts.cells(_slots(spark, d, "train"), LAYER), LAYER)


F1_COUNTS_SQL = with_views(
    f"""WITH {_SPLIT_CTES}
  SELECT layer, token_id, expert, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY layer, token_id) AS BIGINT) AS row_n
  FROM st WHERE split = 'train' GROUP BY layer, token_id, expert""",
    "slots", "doc_splits",
)


def f1_alpha_grid(spark, d):
    train, val, _ = _splits(spark, d)
    g = counts.alpha_grid(train, val, LAYER, N_EXPERTS, TOP_K)
    return g.select("layer", "alpha", rounded(F.col("cross_entropy_bits"), 6).alias("cross_entropy_bits"))


def _f1_scored(split: str) -> str:
    return f"""cells AS (SELECT layer, token_id, expert, count(*) AS n FROM st WHERE split = 'train' GROUP BY ALL),
  rws AS (SELECT layer, token_id, count(*) AS row_n FROM st WHERE split = 'train' GROUP BY ALL),
  grid AS (SELECT unnest([0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0]::DOUBLE[]) AS alpha),
  scored_{split} AS (SELECT st.layer, st.token_id, st.expert, coalesce(n, 0) AS n, coalesce(row_n, 0) AS row_n, prior.p AS prior, ref.p AS reference
    FROM st JOIN prior ON prior.layer = st.layer AND prior.expert = st.expert
    JOIN ref ON ref.split = '{split}' AND ref.layer = st.layer AND ref.expert = st.expert
    LEFT JOIN cells c ON c.layer = st.layer AND c.token_id = st.token_id AND c.expert = st.expert
    LEFT JOIN rws r ON r.layer = st.layer AND r.token_id = st.token_id WHERE st.split = '{split}')"""


_BITS = "-log2((1 - 1e-6::DOUBLE) * (n + alpha * 4 * prior) / (row_n + alpha * 4) + 1e-6::DOUBLE * reference)"
_GRID = f"g AS (SELECT layer, alpha, avg({_BITS}) AS ce FROM scored_val CROSS JOIN grid GROUP BY layer, alpha)"
F1_GRID_SQL = with_views(
    f"""WITH {_SPLIT_CTES}, {_f1_scored('val')}, {_GRID}
  SELECT layer, alpha, round(ce, 6) AS cross_entropy_bits FROM g""",
    "slots", "doc_splits",
)
_F1_TEST = _f1_scored("val") + ",\n  " + _f1_scored("test").split("grid AS", 1)[1].split(",\n", 1)[1]
_BEST = "best AS (SELECT layer, arg_min(alpha, (ce, alpha)) AS alpha FROM g GROUP BY layer)"


def f1_eval(spark, d):
    train, val, test = _splits(spark, d)
    alpha = counts.best_alpha(counts.alpha_grid(train, val, LAYER, N_EXPERTS, TOP_K), LAYER)
    return _mi(test, counts.f1_cross_entropy(train, test, alpha, LAYER, N_EXPERTS, TOP_K))


F1_SQL = with_views(
    f"""WITH {_SPLIT_CTES}, {_F1_TEST}, {_GRID}, {_BEST},
  ce AS (SELECT s.layer, count(*) AS n_slots, avg({_BITS}) AS ce FROM scored_test s JOIN best USING (layer) GROUP BY s.layer)
  {_MI_SELECT}""",
    "slots", "doc_splits",
)


def f1_frequency_strata(spark, d):
    train, val, test = _splits(spark, d)
    alpha = counts.best_alpha(counts.alpha_grid(train, val, LAYER, N_EXPERTS, TOP_K), LAYER)
    rows = counts.f1(train, test, alpha, LAYER, N_EXPERTS, TOP_K)
    s = counts.strata(rows, counts.frequency_buckets(frame(spark, d, "tokens"), 5), LAYER)
    return s.select("layer", F.col("bucket").cast("int").alias("bucket"), "n_slots", rounded(F.col("cross_entropy_bits"), 6).alias("cross_entropy_bits"))


F1_STRATA_SQL = with_views(
    f"""WITH {_SPLIT_CTES}, {_F1_TEST}, {_GRID}, {_BEST},
  b AS (SELECT token_id, ntile(5) OVER (ORDER BY freq, token_id) - 1 AS bucket FROM (SELECT token_id, count(*) AS freq FROM tokens GROUP BY token_id))
  SELECT s.layer, CAST(coalesce(bucket, -1) AS INT) AS bucket, count(*) AS n_slots, round(avg({_BITS}), 6) AS cross_entropy_bits
  FROM scored_test s JOIN best USING (layer) LEFT JOIN b ON b.token_id = s.token_id GROUP BY ALL""",
    "slots", "doc_splits",
)


def _exclusions(feature):
    return lambda spark, d: predictive.exclusions(frame(spark, d, "routed"), feature)


def _exclusions_sql(feature, lost, reason):
    return with_views(
        f"""SELECT layer, '{feature}' AS feature, count(*) FILTER (NOT ({lost})) AS kept, count(*) FILTER ({lost}) AS excluded,
          CASE WHEN count(*) FILTER ({lost}) > 0 THEN '{reason}' END AS reason FROM routed GROUP BY layer""",
        "routed",
    )


def previous_layer_overlap(spark, d):
    """Overlap with the set one layer below, same token."""
    s = frame(spark, d, "slots")
    below = s.select("doc_id", "pos", "expert", (F.col("layer") + 1).alias("layer"), F.lit(1).alias("hit"))
    j = s.where("layer > 0").join(below, ["doc_id", "pos", "layer", "expert"], "left")
    return j.groupBy("layer").agg((F.count("hit") / F.count("*")).alias("x")).select("layer", rounded(F.col("x")).alias("overlap"))


PREVIOUS_LAYER_SQL = with_views(
    """SELECT a.layer, round(count(b.expert) / count(*)::DOUBLE, 9) AS overlap FROM slots a
       LEFT JOIN slots b ON b.doc_id = a.doc_id AND b.pos = a.pos AND b.layer = a.layer - 1 AND b.expert = a.expert WHERE a.layer > 0 GROUP BY a.layer""",
    "slots",
)


def contiguity_check(spark, d):
    return validation.contiguity(frame(spark, d, "tokens"))


CONTIGUITY_SQL = with_views(
    """SELECT count(DISTINCT doc_id) AS n_documents, count(*) AS n_tokens,
         count(*) FILTER (pos <> coalesce(before + 1, 0)) AS out_of_step FROM (
       SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tokens)""",
    "tokens",
)


def ascending_index_check(spark, d):
    t = frame(spark, d, "tokens").select((F.col("doc_id") * 64 + F.col("pos")).alias("index"))
    return validation.ascending(t, "index", shard=F.col("index") % 16)


ASCENDING_SQL = with_views(
    """SELECT index % 16 AS shard, count(*) AS n, count(*) FILTER (index <= before) AS not_ascending FROM (
       SELECT index, lag(index) OVER (PARTITION BY index % 16 ORDER BY index) AS before FROM (SELECT doc_id * 64 + pos AS index FROM tokens)) GROUP BY ALL""",
    "tokens",
)


def stride_check(spark, d):
    return validation.stride(frame(spark, d, "tokens"), span=64, stride=8)


STRIDE_SQL = with_views(
    """SELECT count(*) AS n_tokens, count(*) FILTER ((doc_id * 64 + pos) % 8 = 0) AS n_captured, count(*) FILTER (pos >= 64) AS outside_span FROM tokens""",
    "tokens",
)


def label_range_distinct(spark, d):
    sets = frame(spark, d, "slots").groupBy("doc_id", "pos", "layer").agg(F.sort_array(F.collect_list("expert")).alias("experts"))
    return validation.labels(sets, N_EXPERTS, TOP_K)


LABEL_SQL = with_views(
    """SELECT layer, count(*) AS n, count(*) FILTER (low < 0 OR high > 15) AS out_of_range, count(*) FILTER (d <> 4) AS repeated FROM (
       SELECT layer, doc_id, pos, min(expert) AS low, max(expert) AS high, count(DISTINCT expert) AS d FROM slots GROUP BY ALL) GROUP BY layer""",
    "slots",
)


def token_alignment_check(spark, d):
    t = frame(spark, d, "tokens")
    other = t.withColumn("token_id", F.when((F.col("doc_id") % 97 == 0) & (F.col("pos") == 1), -1).otherwise(F.col("token_id"))).where("NOT (doc_id % 101 = 0 AND pos = 0)")
    return validation.alignment(t, other)


ALIGNMENT_SQL = with_views(
    """WITH o AS (SELECT doc_id, pos, CASE WHEN doc_id % 97 = 0 AND pos = 1 THEN -1 ELSE token_id END AS token_id FROM tokens WHERE NOT (doc_id % 101 = 0 AND pos = 0)),
       j AS (SELECT coalesce(t.doc_id, o.doc_id) AS doc_id, coalesce(t.pos, o.pos) AS pos, t.token_id AS a, o.token_id AS b FROM tokens t FULL JOIN o ON o.doc_id = t.doc_id AND o.pos = t.pos)
       SELECT count(*) AS n, count(*) FILTER (a IS NULL OR b IS NULL) AS unmatched, count(*) FILTER (a <> b) AS different,
         arg_min(doc_id, (doc_id, pos)) FILTER (a IS DISTINCT FROM b) AS first_doc_id, arg_min(pos, (doc_id, pos)) FILTER (a IS DISTINCT FROM b) AS first_pos FROM j""",
    "tokens",
)

LAYERS = N_LAYERS

QUERIES = {
    "repetition_by_layer": repetition_by_layer,
    "event_repetition": event_repetition,
    "slot_counts_zero_filled": slot_counts_zero_filled,
    "marginal_by_split": marginal_by_split,
    "entropy_plugin_mm": entropy_plugin_mm,
    "entropy_nsb": entropy_nsb,
    "load_balance_index": load_balance_index,
    "dead_saturated_experts": dead_saturated_experts,
    "split_coverage_gaps": split_coverage_gaps,
    "f0_marginal_eval": f0_marginal_eval,
    "f1_count_table": f1_count_table,
    "f1_alpha_grid": f1_alpha_grid,
    "f1_eval": f1_eval,
    "f1_frequency_strata": f1_frequency_strata,
    "f2_exclusions": _exclusions("F2"),
    "f3_exclusions": _exclusions("F3"),
    "previous_layer_overlap": previous_layer_overlap,
    "contiguity_check": contiguity_check,
    "ascending_index_check": ascending_index_check,
    "stride_check": stride_check,
    "label_range_distinct": label_range_distinct,
    "token_alignment_check": token_alignment_check,
}
ORACLE_SQL = {
    "repetition_by_layer": REPETITION_SQL,
    "event_repetition": EVENT_REPETITION_SQL,
    "slot_counts_zero_filled": SLOT_COUNTS_SQL,
    "marginal_by_split": MARGINAL_SQL,
    "entropy_plugin_mm": ENTROPY_SQL,
    "load_balance_index": LOAD_BALANCE_SQL,
    "dead_saturated_experts": DEAD_SQL,
    "split_coverage_gaps": SPLIT_GAPS_SQL,
    "f0_marginal_eval": F0_SQL,
    "f1_count_table": F1_COUNTS_SQL,
    "f1_alpha_grid": F1_GRID_SQL,
    "f1_eval": F1_SQL,
    "f1_frequency_strata": F1_STRATA_SQL,
    "f2_exclusions": _exclusions_sql("F2", "layer = 0", "no layer below"),
    "f3_exclusions": _exclusions_sql("F3", "pos = 0", "first token of its document"),
    "previous_layer_overlap": PREVIOUS_LAYER_SQL,
    "contiguity_check": CONTIGUITY_SQL,
    "ascending_index_check": ASCENDING_SQL,
    "stride_check": STRIDE_SQL,
    "label_range_distinct": LABEL_SQL,
    "token_alignment_check": ALIGNMENT_SQL,
}
