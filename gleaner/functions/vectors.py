"""Vector functions as Spark columns. Sums are in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lexical boost: at most WEIGHT, half of it at PIVOT.
BOOST_WEIGHT, BOOST_PIVOT = 0.15, 10.0
NORM_TOLERANCE = 1e-3


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of length 1 in double precision; rows of zeros stay."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size != 0)


def is_valid(v: Column, width: int) -> Column:
    """Not null, of the right width, and without null components."""
    return F.coalesce((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull()), F.lit(False))


def is_unit(v: Column) -> Column:
    return F.abs(norm(v) - 1) <= NORM_TOLERANCE


def lexical_boost(bm25: Column) -> Column:
    """Grows with bm25 but stays below BOOST_WEIGHT; 0 without a match."""
    return F.when(bm25 > 0, F.lit(BOOST_WEIGHT) * bm25 / (bm25 + F.lit(BOOST_PIVOT))).otherwise(F.lit(0.0))
