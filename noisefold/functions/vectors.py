"""Column expressions over feature arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(values: Sequence[float] | np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2(a: str | Column) -> Column:
    """Squared length."""
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x * x)


def distance2(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_clip(a: str | Column, most: float) -> Column:
    """a scaled to length `most` at most."""
    if most <= 0:
        raise ValueError("the clip norm must be positive")
    return F.transform(_col(a), lambda x: x * F.least(F.lit(1.0), F.lit(most) / F.greatest(F.sqrt(norm2(a)), F.lit(1e-12))))


def prefix(a: str | Column, n: int) -> Column:
    return F.slice(_col(a), 1, n)


def gather(a: str | Column, index: Sequence[int]) -> Column:
    """Components at zero-based positions, in the order given."""
    return F.transform(F.array(*map(F.lit, map(int, index))), lambda i: F.element_at(_col(a), i + 1))


def nearest(a: str | Column, centroids: np.ndarray) -> Column:
    """Index of the nearest centroid, ties to the lowest. For few centroids; stats.assign is the fast form."""
    return F.array_min(F.array(*(F.struct(distance2(a, literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids))))["i"]


def clean(x: str | Column) -> Column:
    """NaN as null: Spark's aggregates skip null only."""
    return F.when(~F.isnan(_col(x)), _col(x))


def close(a: str | Column, b: float | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equal within atol + rtol * |b|."""
    return F.abs(_col(a) - b) <= atol + rtol * F.abs(F.lit(b) if not isinstance(b, Column) else b)
