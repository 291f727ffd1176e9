"""Vectors in Arrow batches as matrices of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors of dim components, none null or non-finite."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)  # null components come out as NaN
    x = np.asarray(flat, dtype=np.float64).reshape(len(at), dim)
    good = np.isfinite(x).all(1)
    return at[good], x[good]


def floored(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as integers; an error where one exceeds most, beyond which what is made of them would not be exact."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if y.size and not np.abs(y).max() <= most:
        raise ValueError(f"a component exceeds {most} / {scale}: results would not be exact")
    return y.astype(np.int64)


def is_finite(vector: str, dim: int) -> Column:
    """The same choice as finite_rows, as a predicate."""
    v = F.col(vector)
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
