"""Refusals: conditions under which a result would be wrong rather than missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes of a gate: it ran and passed, it ran and failed, it could not run.
PASSED, FAILED, COULD_NOT_RUN = 0, 1, 2


class Refused(ValueError):
    """The input breaks a rule that the result would silently depend on."""


def refuse_if_any(df: DataFrame, what: str) -> None:
    """Raises with the first offending row if there is one."""
    rows = df.take(1)
    if rows:
        raise Refused(f"{what}: {rows[0].asDict()}")


def require_unique(df: DataFrame, *columns: str) -> None:
    """Raises if a key is null or repeats."""
    null = F.lit(False)
    for c in columns:
        null = null | F.col(c).isNull()
    refuse_if_any(df.where(null), f"null in {', '.join(columns)}")
    refuse_if_any(df.groupBy(*columns).count().where("count > 1"), f"{', '.join(columns)} is not unique")


def rounded(value: Column, digits: int = 9) -> Column:
    """Rounded for comparison, with no negative zero; NaN and null stay."""
    return F.round(value, digits) + F.lit(0.0).cast("double")
