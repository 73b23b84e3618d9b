"""What both vector operators need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero and holds neither nulls nor non-finite values."""
    e = F.col(vector)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(e.isNotNull() & F.coalesce(F.forall(e, fine), F.lit(False)) & F.exists(e, lambda x: x != 0))


def as_doubles(vector: str | Column = "embedding") -> Column:
    return F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))


def matrix(column: pa.Array) -> np.ndarray:
    """List column of equally long vectors as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows get equal values wherever they stand."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
