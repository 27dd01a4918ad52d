"""Vectors in numpy: which rows count, and cosines that do not depend on how rows are batched."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold only finite components."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of equal length as doubles."""
    return np.array([np.asarray(v, np.float64) for v in column], np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, keepdims=True)
    scaled = rows / top
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products summed from the first component on, so that equal inputs give equal bits in any batch."""
    return np.add.accumulate(a * b, axis=1)[:, -1] if len(a) else np.empty(0)


def _scaled(a: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to about 1: no digit changes, no square overflows."""
    return np.ldexp(a, -np.frexp(np.abs(a).max(axis=1, keepdims=True))[1]) if a.size else a


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` with the same row of `b`, in doubles, whatever their size."""
    a, b = _scaled(a), _scaled(b)
    return np.clip(_dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b))), -1.0, 1.0)
