"""Vectors as blocks: many rows in one, so that a task multiplies matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def stacked(vectors) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))
