import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import arrays
from tracewright.operators import checks, counts, drift, information, predictive, validation
from tracewright.plans import score_queries, trace_queries


def slots_of(spark, sets, layer=0):
    return spark.createDataFrame([(i, 0, i, layer, e) for i, s in enumerate(sets) for e in s], "doc_id long, pos int, token_id long, layer int, expert int")


def test_hand_computed_recall(spark):
    """Five experts, k = 2, three rows worked out by hand. By score: 3 1 4 0 2; 0 2 1 4 3; 2 4 0 3 1.
    Hits among the first two: 3 of {3, 4}; 0 and 2 of {2, 0}; none of {0, 1}: 1 + 2 + 0 of 6 slots.
    Among the first four: 3, 4; 2, 0; 0 alone: 5 of 6. All five hold every slot. One set of three is equal."""
    rows = [(0, [0.2, 0.7, 0.1, 0.9, 0.3], [3, 4]), (0, [8.0, 3.0, 5.0, 0.0, 1.0], [2, 0]), (0, [-2.0, -7.0, 4.0, -3.0, 0.5], [0, 1])]
    found = {r.m: (r.recall, r.exact_match) for r in predictive.recall_curve(spark.createDataFrame(rows, "layer int, scores array<double>, truth array<int>"), ["layer"], 2, 5).collect()}
    third = pytest.approx(1 / 3)
    assert found == {2: (pytest.approx(1 / 2), third), 4: (pytest.approx(5 / 6), third), 5: (pytest.approx(1.0), third)}


def test_budgets_are_capped_and_distinct():
    assert predictive.budgets(8, 64) == [8, 16, 32] and predictive.budgets(4, 6) == [4, 6] and predictive.budgets(6, 6) == [6]


def test_cross_entropy_by_hand(spark):
    # slots 0 and 1 with probabilities 1/2 and 1/4: (1 + 2) / 2 bits
    rows = spark.createDataFrame([(0, 0.5, 0.25), (0, 0.25, 0.25)], "layer int, q double, reference double")
    assert information.cross_entropy(rows, ["layer"], epsilon=0.0).first()["cross_entropy_bits"] == pytest.approx(1.5)


def test_own_marginal_gives_plugin_entropy(spark):
    sets = [[0, 1], [0, 2], [0, 1], [1, 2]]
    s = slots_of(spark, sets)
    c = information.slot_counts(s, ["layer"], 3)
    p = information.marginal(c, ["layer"])
    rows = s.join(p, ["layer", "expert"]).withColumn("q", F.col("p")).withColumn("reference", F.col("p"))
    e = information.entropies(c, ["layer"]).first()
    assert information.cross_entropy(rows, ["layer"]).first()["cross_entropy_bits"] == pytest.approx(e["plugin"])


def test_miller_madow_by_hand_and_zero_filled_counts(spark):
    c = information.slot_counts(slots_of(spark, [[0], [1], [2], [3]]), ["layer"], 5)
    assert sorted((r.expert, r.n) for r in c.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    # 2 bits + 3 / (8 ln 2)
    assert information.entropies(c, ["layer"]).first()["miller_madow"] == pytest.approx(2 + 3 / (8 * math.log(2)))
    with pytest.raises(Exception, match="out of range"):
        information.slot_counts(slots_of(spark, [[7]]), ["layer"], 5).collect()


def test_special_functions():
    euler = 0.5772156649015329
    assert information._digamma(np.array([1.0, 0.5, 3.0])) == pytest.approx([-euler, -euler - 2 * math.log(2), 1.5 - euler])
    assert information._trigamma(np.array([1.0, 0.5])) == pytest.approx([math.pi**2 / 6, math.pi**2 / 2])


def test_nsb_between_zero_and_the_top_and_near_truth_with_many_samples():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(16))
    true = float(-(p * np.log2(p)).sum())
    assert information.nsb(rng.multinomial(200_000, p)) == pytest.approx(true, abs=0.01)
    few = [information.nsb(rng.multinomial(12, p)) for _ in range(200)]
    plain = [information.nsb(np.zeros(16)), information.nsb(np.eye(16)[0] * 9)]
    assert plain == [0.0, 0.0] and abs(np.mean(few) - true) < 0.35


def test_mi_is_signed_and_nan_without_entropy(spark):
    h = spark.createDataFrame([(0, 1.0), (1, 0.0)], "layer int, entropy_bits double")
    ce = spark.createDataFrame([(0, 8, 1.5), (1, 8, 0.1)], "layer int, n_slots long, cross_entropy_bits double")
    r = {x.layer: x for x in information.mutual_information(h, ce, ["layer"], 4).collect()}
    assert r[0].mi_bits == -0.5 and r[0].negative and r[0].ratio == -0.5 and r[0].ce_normalized == 0.75
    assert math.isnan(r[1].ratio)
    with pytest.raises(checks.Refused):
        information.require_same_split("test", "val")
    with pytest.raises(checks.Refused):
        information.require_distributions(spark.createDataFrame([([0.5, 0.4],)], "q array<double>"))


def test_constant_router_has_the_balance_of_three_of_sixteen(spark):
    c = information.slot_counts(slots_of(spark, [[1, 5, 9]] * 400), ["layer"], 16)
    r = information.load_balance(c, ["layer"], 16).first()
    assert r.load_balance == pytest.approx(math.log2(3) / 4, abs=1e-3) and information.usage(c, ["layer"]).first().dead == 13


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_repetition_of_planted_documents(spark, partitions):
    # document 0 repeats its set, document 1 moves one of two experts each step
    rows = [(0, t, 0, e) for t in range(5) for e in (1, 2)] + [(1, t, 0, e) for t in range(4) for e in (t, t + 1)]
    random.Random(partitions).shuffle(rows)
    s = spark.createDataFrame(rows, "doc_id long, pos int, layer int, expert int").repartition(partitions)
    r = predictive.repetition(s, 2, 8).first()
    assert (r.n_rows, r.excluded) == (7, 2)
    assert r.repetition_rate == pytest.approx((4 * 1 + 3 * 0.5) / 7) and r.exact_repeat_rate == pytest.approx(4 / 7) and r.chance == 0.25


def test_token_driven_routing_is_found_by_counts_and_not_by_the_marginal(spark):
    rng = random.Random(2)
    route = {t: rng.sample(range(8), 2) for t in range(40)}
    rows = [(i, 0, t, 0, e) for i in range(3000) for t in [rng.randrange(40)] for e in route[t]]
    s = spark.createDataFrame(rows, "doc_id long, pos int, token_id long, layer int, expert int")
    train, val, test = (counts.cells(s.where(f"doc_id % 10 {c}"), ["layer"]) for c in ("< 6", "IN (6, 7)", "> 7"))
    grid = counts.alpha_grid(train, val, ["layer"], 8, 2)
    alpha = counts.best_alpha(grid, ["layer"])
    assert alpha.first().alpha == 0.1
    ce = counts.f1_cross_entropy(train, test, alpha, ["layer"], 8, 2).first()["cross_entropy_bits"]
    assert ce < 1.05 < 2.5 < counts.f0(train, test, ["layer"], 8).first()["cross_entropy_bits"]
    strata = counts.strata(counts.f1(train, test, alpha, ["layer"], 8, 2), counts.frequency_buckets(s.where("token_id < 30"), 3), ["layer"]).collect()
    assert {r.bucket for r in strata} == {-1, 0, 1, 2}


def test_array_expressions(spark):
    r = spark.createDataFrame([([0.5, 0.9, 0.5, 0.1], [1.0, 1.0, 1.0, 1.0])], "a array<double>, b array<double>").select(
        arrays.top_m(F.col("a"), 3).alias("top"), arrays.margin(F.col("a"), 2).alias("tie"), arrays.margin(F.col("a"), 4).alias("none"),
        arrays.average_ranks(F.col("a")).alias("ranks"), arrays.spearman(F.col("a"), F.col("b")).alias("nan"), arrays.spearman(F.col("a"), F.col("a")).alias("one"),
        arrays.distinct(F.col("a")).alias("distinct"), F.aggregate(arrays.softmax(F.col("a")), F.lit(0.0), lambda x, y: x + y).alias("sum"),
    ).first()
    assert r.top == [1, 0, 2] and r.tie == 0 and r.none is None and r.ranks == [2.5, 4.0, 2.5, 1.0]
    assert math.isnan(r.nan) and r.one == pytest.approx(1.0) and not r.distinct and r.sum == pytest.approx(1.0)
    with pytest.raises(ValueError):
        arrays.top_m(F.col("a"), 0)


def test_every_token_has_a_multi_hot_row(spark, monkeypatch):
    order = [random.Random(t).sample(range(score_queries.N_SCORES), score_queries.N_SCORES) for t in range(25)]
    rows = spark.createDataFrame([(t, [float(x) for x in o]) for t, o in enumerate(order)], "token long, scores array<double>")
    monkeypatch.setattr(score_queries, "_scores", lambda *_: rows)
    found = {r.token: r.hot for r in score_queries.multi_hot_rows(spark, "").collect()}
    assert found == {t: "".join("1" if x >= score_queries.N_SCORES - score_queries.SCORE_K else "0" for x in o) for t, o in enumerate(order)}


def test_an_expert_of_any_document_is_not_dead(spark, monkeypatch):
    # In layer 2 expert e is selected by document e alone, expert 15 by none.
    slots = spark.createDataFrame([(e, 0, e, layer, e) for layer in (0, 2) for e in range(15)], "doc_id long, pos int, token_id long, layer int, expert int")
    monkeypatch.setattr(trace_queries, "_slots", lambda *_: slots)
    assert sorted((r.layer, r.dead) for r in trace_queries.dead_saturated_experts(spark, "").collect()) == [(0, 1), (2, 1)]


def test_strata_leave_unseen_tokens_apart_and_the_query_has_none(spark):
    rows = spark.createDataFrame([(0, t, 0.5, 0.5, 1) for t in range(4)], "layer int, token_id long, q double, reference double, times long")
    seen = spark.createDataFrame([(t,) for t in range(3) for _ in range(t + 1)], "token_id long")
    found = {r.bucket: r.n_slots for r in counts.strata(rows, counts.frequency_buckets(seen, 3), ["layer"]).collect()}
    assert found == {-1: 1, 0: 1, 1: 1, 2: 1}
    assert {r.bucket for r in trace_queries.f1_frequency_strata(spark, "/root/testdata/sf0.001").collect()} == set(range(5))


def test_margin_edges_are_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    sets = {0: rng.exponential(size=3000), 1: rng.integers(0, 4, 500) / 4.0, 2: np.array([0.5])}
    frame = spark.createDataFrame([(k, float(x)) for k, v in sets.items() for x in v], "layer int, margin double")
    found = {r.layer: r.edges for r in drift.margin_edges(frame.repartition(5), parts=16).collect()}
    for k, v in sets.items():
        expect = list(dict.fromkeys(np.quantile(v, drift.MARGIN_QUANTILES).round(12)))
        assert np.round(found[k], 12).tolist() == pytest.approx(expect)


@pytest.mark.parametrize("buckets, types", [(10, 37), (5, 5), (4, 2), (3, 9)])
def test_frequency_buckets_are_parts_of_the_order(spark, buckets, types):
    rows = [(t * 40_000,) for t in range(types) for _ in range(1 + (t * 7) % 5)]
    found = {r.token_id: r.bucket for r in counts.frequency_buckets(spark.createDataFrame(rows, "token_id long"), buckets).collect()}
    order = sorted(range(types), key=lambda t: (1 + (t * 7) % 5, t))
    parts = np.array_split(np.array(order), buckets)
    assert found == {int(t) * 40_000: k for k, part in enumerate(parts) for t in part}


def test_rows_out_of_order_are_counted_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(validation, "SPAN", 10)
    index = [*range(25), 20, 21, 22, 22, *range(23, 60), 5]
    frame = spark.createDataFrame(list(enumerate(index)), "row_id long, idx long")
    found = validation.ascending(frame.repartition(4), "idx", F.lit(0), "row_id").first()
    assert (found["n"], found["not_ascending"]) == (len(index), sum(b <= a for a, b in zip(index, index[1:])))
    assert validation.ascending(frame, "idx", F.lit(0)).first()["not_ascending"] == len(index) - len(set(index))
