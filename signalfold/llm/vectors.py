"""Vectors as exact integers, shared by the operators that cluster and code them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_vectors(vector_col: str = "embedding") -> Column:
    """Whether the vector is neither null nor holds null or non-finite components."""
    v = F.col(vector_col)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def floored(scale: int, vector_col: str = "embedding") -> Column:
    """floor(scale * x) of each component, exactly: scale is a power of 2. What a long cannot hold is cut to its ends."""
    return F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list column of equally long integer lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(rows, -1)


def check_range(x: np.ndarray, dims: int) -> None:
    """Squared distances over dims components must fit in a long."""
    most = int(np.sqrt(2.0**62 / max(dims, 1)) / 2)
    if x.size and max(int(x.max()), -int(x.min())) > most:
        raise OverflowError(f"components beyond {most} after scaling have no squared distance that fits in 64 bits")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows, exact in int64."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)
