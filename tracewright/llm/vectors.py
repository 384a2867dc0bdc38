"""What the operators on embeddings share: which vectors take part, and their form between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """True for vectors that are not null and hold neither nulls nor non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad, F.lit(False))


def as_rows(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v`` of all rows, the vector in the precision it came in, whatever other columns are
    called."""
    kind = "array<float>" if df.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(kind).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of one length and without nulls, as doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)
