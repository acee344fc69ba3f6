"""What the operators on embedding tables have in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` (array of double) of the rows whose vector is not null or empty and has finite entries only."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    chosen = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return chosen.where((F.size("vector") > 0) & F.forall("vector", entry))


def common_length(rows: DataFrame, column: str) -> int:
    """The length that most arrays have, the largest of ties; 0 if there is no row."""
    found = rows.groupBy(F.size(column).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return found["length"] if found else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` entries, one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def of_length(column: str, width: int) -> Column:
    return F.size(column) == width
