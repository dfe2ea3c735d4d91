"""What the two vector operators share: which vectors take part, and matrices of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> F.Column:
    """Not null, not all zero, no null or non-finite component."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one dimension as float64, the values as they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def prepared(vectors: DataFrame) -> DataFrame:
    """Usable rows only, with their dimension: vectors of different dimension never meet."""
    return vectors.filter(usable()).withColumn("dim", F.size("embedding"))
