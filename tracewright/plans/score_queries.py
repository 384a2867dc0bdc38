"""Queries over dense score rows: ``embeddings`` as 64 experts, k = 8, its label as the layer, and a
coarsely rounded copy as the second trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import drift, predictive, validation
from ..operators.checks import rounded
from .views import N_SCORES, SCORE_K, frame


def _scores(spark, d):
    e = frame(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("token"), F.col("label").alias("layer"), F.transform("embedding", lambda x: x.cast("double")).alias("scores"))


def _coarse(rows):
    """Scores to the nearest eighth, halves away from zero: makes real ties."""
    return rows.withColumn("scores", F.transform("scores", lambda x: F.round(x * 8) / F.lit(8.0).cast("double") + F.lit(0.0).cast("double")))


def _pairs(spark, d):
    rows = _scores(spark, d)
    return drift.pair(rows, _coarse(rows), ["token"], SCORE_K)


_ROWS = """s AS (SELECT vec_id AS token, label AS layer, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
  p AS (SELECT *, list_transform(a, lambda x: round(x * 8) / 8.0::DOUBLE + 0.0::DOUBLE) AS b FROM s)"""
_TOP = """long AS (SELECT token, layer, generate_subscripts(a, 1) - 1 AS e, unnest(a) AS x, unnest(b) AS y FROM p),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY x DESC, e) AS ra, row_number() OVER (PARTITION BY token ORDER BY y DESC, e) AS rb,
      row_number() OVER (PARTITION BY token ORDER BY x) + 0.0 AS _o,
      rank() OVER (PARTITION BY token ORDER BY x) + (count(*) OVER (PARTITION BY token, x) - 1) / 2.0::DOUBLE AS sa,
      rank() OVER (PARTITION BY token ORDER BY y) + (count(*) OVER (PARTITION BY token, y) - 1) / 2.0::DOUBLE AS sb FROM long),
  pairs AS (SELECT token, any_value(layer) AS layer, count(*) FILTER (ra <= 8 AND rb <= 8) AS shared,
      bool_and(ra <> rb OR TRUE) AS _t, list(e ORDER BY ra) FILTER (ra <= 8) AS seq_a, list(e ORDER BY rb) FILTER (rb <= 8) AS seq_b,
      CASE WHEN var_pop(sa) = 0 OR var_pop(sb) = 0 THEN 'nan'::DOUBLE ELSE covar_pop(sa, sb) / sqrt(var_pop(sa) * var_pop(sb)) END AS rho,
      max(x) FILTER (ra = 8) - max(x) FILTER (ra = 9) AS margin FROM ranked GROUP BY token)"""
_LAYERS = """layers AS (SELECT layer, count(*) AS n, avg(shared / 8.0::DOUBLE) AS set_agreement, avg(CASE WHEN shared = 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS exact_match,
      avg(rho) FILTER (NOT isnan(rho)) AS spearman, avg(CASE WHEN shared = 8 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS flip_rate FROM pairs GROUP BY layer)"""


def topm_recall_curve(spark, d):
    rows = _scores(spark, d)
    truth = _coarse(rows).select("token", arrays.top_m(F.col("scores"), SCORE_K).alias("truth"))
    r = predictive.recall_curve(rows.join(truth, "token"), ["layer"], SCORE_K, N_SCORES)
    return r.select("layer", "n", rounded(F.col("exact_match")).alias("exact_match"), "m", rounded(F.col("recall")).alias("recall"))


RECALL_SQL = f"""WITH {_ROWS}, {_TOP}
  SELECT layer, count(DISTINCT token) AS n, round(avg(CASE WHEN hit8 = 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS exact_match, m, round(avg(hit / 8.0::DOUBLE), 9) AS recall FROM (
    SELECT r.token, any_value(r.layer) AS layer, m, count(*) FILTER (rb <= 8 AND ra <= m) AS hit, count(*) FILTER (rb <= 8 AND ra <= 8) AS hit8
    FROM ranked r CROSS JOIN (SELECT unnest([8, 16, 32]) AS m) GROUP BY r.token, m) GROUP BY layer, m"""


def exact_set_vs_sequence(spark, d):
    p = _pairs(spark, d)
    return p.groupBy("layer").agg(F.count("*").alias("n"), F.count_if("same_set").alias("same_set"), F.count_if("same_sequence").alias("same_sequence"))


EXACT_SQL = f"WITH {_ROWS}, {_TOP} SELECT layer, count(*) AS n, count(*) FILTER (shared = 8) AS same_set, count(*) FILTER (seq_a = seq_b) AS same_sequence FROM pairs GROUP BY layer"


def rank_average(spark, d):
    rows = _coarse(_scores(spark, d))
    r = rows.select("token", F.posexplode(arrays.average_ranks(F.col("scores"))).alias("expert", "rank"))
    return r.select("token", "expert", "rank")


RANK_SQL = f"WITH {_ROWS}, {_TOP} SELECT token, CAST(e AS INT) AS expert, sb AS rank FROM ranked"


def spearman_by_row(spark, d):
    return _pairs(spark, d).select("token", "layer", rounded(F.col("spearman"), 8).alias("spearman"))


SPEARMAN_SQL = f"WITH {_ROWS}, {_TOP} SELECT token, layer, round(rho, 8) AS spearman FROM pairs"


def topk_margin(spark, d):
    return _scores(spark, d).select("token", "layer", arrays.margin(F.col("scores"), SCORE_K).alias("margin"))


MARGIN_SQL = f"WITH {_ROWS}, {_TOP} SELECT token, layer, margin FROM pairs"


def margin_quantile_bins(spark, d):
    e = drift.margin_edges(_pairs(spark, d))
    return e.select("layer", F.posexplode("edges").alias("place", "edge")).select("layer", "place", rounded(F.col("edge")).alias("edge"))


_EDGES = "edges AS (SELECT layer, list_distinct(quantile_cont(margin, [0.0, 0.05, 0.2, 0.5, 0.8, 1.0])) AS q FROM pairs GROUP BY layer), es AS (SELECT layer, list_sort(q) AS q FROM edges)"
BINS_SQL = f"WITH {_ROWS}, {_TOP}, {_EDGES} SELECT layer, CAST(generate_subscripts(q, 1) - 1 AS INT) AS place, round(unnest(q), 9) AS edge FROM es"


def flip_rate_by_margin(spark, d):
    r = drift.flips_by_margin(_pairs(spark, d))
    return r.select("layer", "bin", "n", rounded(F.col("flip_rate")).alias("flip_rate"))


FLIP_SQL = f"""WITH {_ROWS}, {_TOP}, {_EDGES},
  spine AS (SELECT layer, q, unnest(range(greatest(len(q) - 1, 1))) AS bin FROM es),
  b AS (SELECT p.layer, len(list_filter(q[2:len(q) - 1], lambda x: x <= p.margin)) AS bin, shared FROM pairs p JOIN es USING (layer))
  SELECT s.layer, CAST(s.bin AS INT) AS bin, count(b.shared) AS n,
    coalesce(round(avg(CASE WHEN b.shared = 8 THEN 0.0::DOUBLE WHEN b.shared IS NOT NULL THEN 1.0::DOUBLE END), 9), 'nan'::DOUBLE) AS flip_rate
  FROM spine s LEFT JOIN b ON b.layer = s.layer AND b.bin = s.bin GROUP BY s.layer, s.bin"""


def layer_drift(spark, d):
    r = drift.per_layer(_pairs(spark, d))
    return r.select("layer", "n", *[rounded(F.col(c), 8).alias(c) for c in ("set_agreement", "exact_match", "spearman", "flip_rate")])


DRIFT_SQL = f"""WITH {_ROWS}, {_TOP}, {_LAYERS}
  SELECT layer, n, round(set_agreement, 8) AS set_agreement, round(exact_match, 8) AS exact_match, round(spearman, 8) AS spearman, round(flip_rate, 8) AS flip_rate FROM layers"""


def worst_layer(spark, d):
    s = drift.summary(drift.per_layer(_pairs(spark, d)))
    return s.select(rounded(F.col("mean_agreement"), 8).alias("mean_agreement"), "worst_layer", rounded(F.col("worst_agreement"), 8).alias("worst_agreement"))


WORST_SQL = f"""WITH {_ROWS}, {_TOP}, {_LAYERS}
  SELECT round(avg(set_agreement), 8) AS mean_agreement, arg_min(layer, (set_agreement, layer)) AS worst_layer, round(min(set_agreement), 8) AS worst_agreement FROM layers"""


def precision_band(spark, d):
    return drift.summary(drift.per_layer(_pairs(spark, d))).select("interpretation")


BAND_SQL = f"""WITH {_ROWS}, {_TOP}, {_LAYERS}
  SELECT CASE WHEN avg(set_agreement) >= 0.97 THEN 'bounded' WHEN avg(set_agreement) < 0.90 THEN 'severe' ELSE 'moderate' END AS interpretation FROM layers"""


def equivalence_gate(spark, d):
    return drift.summary(drift.per_layer(_pairs(spark, d))).select("worst_layer", "equivalent")


GATE_SQL = f"""WITH {_ROWS}, {_TOP}, {_LAYERS}
  SELECT arg_min(layer, (set_agreement, layer)) AS worst_layer, min(set_agreement) >= 0.999 AS equivalent FROM layers"""


def depth_trend(spark, d):
    r = drift.depth_trend(drift.per_layer(_pairs(spark, d)))
    return r.select("n_layers", rounded(F.col("trend"), 8).alias("trend"))


TREND_SQL = f"""WITH {_ROWS}, {_TOP}, {_LAYERS},
  r AS (SELECT rank() OVER (ORDER BY layer) AS x, rank() OVER (ORDER BY flip_rate) + (count(*) OVER (PARTITION BY flip_rate) - 1) / 2.0::DOUBLE AS y FROM layers)
  SELECT count(*) AS n_layers, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 8) AS trend FROM r"""


def tie_fraction(spark, d):
    rows = _coarse(_scores(spark, d))
    tied = F.avg((~arrays.distinct(F.col("scores"))).cast("double"))
    return rows.groupBy("layer").agg(F.count("*").alias("n"), tied.alias("x")).select("layer", "n", rounded(F.col("x")).alias("tied"))


TIE_SQL = f"WITH {_ROWS} SELECT layer, count(*) AS n, round(avg(CASE WHEN len(list_distinct(b)) < len(b) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS tied FROM p GROUP BY layer"


def strided_read_hypothesis(spark, d):
    """Sets read correctly (the first k of each row of ids) against sets read as if rows were k wide:
    the share of tokens for which both readings give the same set. Ids are a row's ranking."""
    ids = _scores(spark, d).select("token", F.posexplode(arrays.ranked(F.col("scores"))).alias("place", "expert"))
    flat = ids.select("token", "place", "expert", (F.col("token") * N_SCORES + F.col("place")).alias("at"))
    right = flat.where(F.col("place") < SCORE_K).select("token", "expert")
    wrong = flat.select(F.floor(F.col("at") / SCORE_K).alias("token"), "expert")
    both = right.join(wrong, ["token", "expert"]).groupBy("token").agg(F.countDistinct("expert").alias("n"))
    total = ids.select("token").distinct()
    out = total.join(both, "token", "left").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("n") == SCORE_K).alias("same"), F.coalesce(F.sum("n"), F.lit(0)).alias("shared"))
    return out.select("n_tokens", "same", "shared")


STRIDED_SQL = f"""WITH {_ROWS}, {_TOP},
  f AS (SELECT token, ra - 1 AS place, e, token * 64 + ra - 1 AS at FROM ranked),
  j AS (SELECT a.token, count(DISTINCT a.e) AS n FROM f a JOIN f w ON w.at // 8 = a.token AND w.e = a.e WHERE a.place < 8 GROUP BY a.token)
  SELECT (SELECT count(*) FROM p) AS n_tokens, count(*) FILTER (n = 8) AS same, CAST(coalesce(sum(n), 0) AS BIGINT) AS shared FROM j"""


def selection_argsort_agreement(spark, d):
    rows = _scores(spark, d)
    truth = rows.select("token", arrays.top_m(F.col("scores"), SCORE_K).alias("truth"))
    return validation.argsort_agreement(_coarse(rows).join(truth, "token"), SCORE_K)


ARGSORT_SQL = f"""WITH {_ROWS}, {_TOP},
  t AS (SELECT token, max(y) FILTER (rb = 8) - max(y) FILTER (rb = 9) AS margin_b FROM ranked GROUP BY token)
  SELECT count(*) AS n, count(*) FILTER (shared = 8) AS agree, count(*) FILTER (shared < 8 AND margin_b = 0) AS tied, count(*) FILTER (shared < 8 AND margin_b <> 0) AS unexplained
  FROM pairs JOIN t USING (token)"""


def nonfinite_scan(spark, d):
    rows = _scores(spark, d)
    poisoned = F.transform("scores", lambda x, i: F.when((F.col("token") % 50 == 7) & (i == 3), F.lit(float("nan"))).when((F.col("token") % 90 == 11) & (i == 5), F.lit(float("inf"))).otherwise(x))
    return validation.nonfinite(rows.withColumn("scores", poisoned), k=SCORE_K)


NONFINITE_SQL = f"""WITH {_ROWS}, {_TOP}
  SELECT count(*) AS n, count(*) FILTER (token % 50 = 7 OR token % 90 = 11) AS nonfinite, min(token) FILTER (token % 50 = 7 OR token % 90 = 11) AS first_token,
    min(margin) FILTER (NOT (token % 50 = 7 OR token % 90 = 11)) AS least_margin FROM pairs"""


def standardiser(spark, d):
    """Mean and population deviation of each score, from tokens of the train part alone; the deviation
    is floored."""
    train = _scores(spark, d).where("token % 4 <> 0").select(F.posexplode("scores").alias("expert", "x"))
    s = train.groupBy("expert").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("s"))
    return s.select("expert", rounded(F.col("m")).alias("mean"), rounded(F.col("s")).alias("std"))


STANDARDISER_SQL = f"""WITH {_ROWS}, {_TOP}
  SELECT CAST(e AS INT) AS expert, round(avg(x), 9) AS mean, round(greatest(stddev_pop(x), 1e-6), 9) AS std FROM long WHERE token % 4 <> 0 GROUP BY e"""


def multi_hot_rows(spark, d):
    rows = _scores(spark, d)
    hot = arrays.multi_hot(arrays.top_m(F.col("scores"), SCORE_K), N_SCORES)
    return rows.select("token", F.array_join(hot.cast("array<string>"), "").alias("hot"))


MULTI_HOT_SQL = f"""WITH {_ROWS}, {_TOP} SELECT token, string_agg(CASE WHEN ra <= 8 THEN '1' ELSE '0' END, '' ORDER BY e) AS hot FROM ranked GROUP BY token"""

QUERIES = {
    "topm_recall_curve": topm_recall_curve, "exact_set_vs_sequence": exact_set_vs_sequence, "rank_average": rank_average, "spearman_by_row": spearman_by_row,
    "topk_margin": topk_margin, "margin_quantile_bins": margin_quantile_bins, "flip_rate_by_margin": flip_rate_by_margin, "layer_drift": layer_drift,
    "worst_layer": worst_layer, "precision_band": precision_band, "equivalence_gate": equivalence_gate, "depth_trend": depth_trend, "tie_fraction": tie_fraction,
    "strided_read_hypothesis": strided_read_hypothesis, "selection_argsort_agreement": selection_argsort_agreement, "nonfinite_scan": nonfinite_scan,
    "standardiser": standardiser, "multi_hot_rows": multi_hot_rows,
}
ORACLE_SQL = {
    "topm_recall_curve": RECALL_SQL, "exact_set_vs_sequence": EXACT_SQL, "rank_average": RANK_SQL, "spearman_by_row": SPEARMAN_SQL, "topk_margin": MARGIN_SQL,
    "margin_quantile_bins": BINS_SQL, "flip_rate_by_margin": FLIP_SQL, "layer_drift": DRIFT_SQL, "worst_layer": WORST_SQL, "precision_band": BAND_SQL,
    "equivalence_gate": GATE_SQL, "depth_trend": TREND_SQL, "tie_fraction": TIE_SQL, "strided_read_hypothesis": STRIDED_SQL,
    "selection_argsort_agreement": ARGSORT_SQL, "nonfinite_scan": NONFINITE_SQL, "standardiser": STANDARDISER_SQL, "multi_hot_rows": MULTI_HOT_SQL,
}
