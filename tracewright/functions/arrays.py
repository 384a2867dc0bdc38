"""Expressions on selected sets and score rows. Sets are arrays of expert ids; score rows are arrays
whose index is the expert."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranked(scores: Column) -> Column:
    """All expert ids by score, the highest first; equal scores by the smaller id."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("minus"), i.alias("expert")))
    return F.transform(F.sort_array(pairs), lambda p: p["expert"])


def top_m(scores: Column, m: int) -> Column:
    """The ids of the m highest scores, in rank order; all if there are fewer."""
    if m < 1:
        raise ValueError("m is less than 1")
    return F.slice(ranked(scores), 1, m)


def overlap(a: Column, b: Column) -> Column:
    """Number of ids in both sets."""
    return F.size(F.array_intersect(a, b))


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets: order does not count."""
    return F.sort_array(a) == F.sort_array(b)


def same_sequence(a: Column, b: Column) -> Column:
    """Equal as sequences: order counts."""
    return a == b


def distinct(a: Column) -> Column:
    """True if no element repeats."""
    return F.size(F.array_distinct(a)) == F.size(a)


def multi_hot(experts: Column, n_experts: int) -> Column:
    """0/1 row of a set."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_experts - 1)), lambda e: F.array_contains(experts, e).cast("int"))


def margin(scores: Column, k: int) -> Column:
    """k-th minus (k+1)-th highest score; null if there is no (k+1)-th."""
    down = F.reverse(F.sort_array(scores))
    return F.get(down, F.lit(k - 1)) - F.get(down, F.lit(k))


def average_ranks(values: Column) -> Column:
    """Ranks from 1 with ties averaged, in the order of the array."""
    return F.transform(
        values,
        lambda v: F.size(F.filter(values, lambda x: x < v)) + (F.size(F.filter(values, lambda x: x == v)) + 1) / F.lit(2.0).cast("double"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def spearman(a: Column, b: Column) -> Column:
    """Rank correlation of two rows with ties averaged; NaN if either is constant."""
    ra, rb, n = average_ranks(a), average_ranks(b), F.size(a)
    mean = (n + 1) / F.lit(2.0).cast("double")
    cov = _sum(F.zip_with(ra, rb, lambda x, y: (x - mean) * (y - mean)))
    va, vb = (_sum(F.transform(r, lambda x: (x - mean) * (x - mean))) for r in (ra, rb))
    return F.coalesce(F.try_divide(cov, F.sqrt(va * vb)), F.lit(float("nan")))


def softmax(scores: Column) -> Column:
    """Probabilities of a score row, shifted by its maximum."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(powers, lambda p: p / _sum(powers))


def de_stride(row: Column, k: int) -> Column:
    """The first k entries of a row that holds all experts: the selection of a strided view."""
    return F.slice(row, 1, k)
