"""Helpers for tables of vectors: which rows hold one, and what length they share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(False))


def dimension(kept: DataFrame, parts: int = 1) -> int | None:
    """The commonest vector length that divides into the parts; ties: the shortest."""
    sizes = kept.groupBy(F.size("embedding").alias("dim")).count().filter(f"dim > 0 AND dim % {parts} = 0")
    found = sizes.orderBy(F.desc("count"), "dim").limit(1).collect()
    return found[0]["dim"] if found else None


def whole_numbers(flat: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x), saturated at ``limit`` in size."""
    return np.clip(np.floor(flat.astype(np.float64) * scale), -limit, limit).astype(np.int64)
