"""Random draws keyed by strings: the same on every partitioning, in Python and in SQL.

u = (first 13 hex digits of md5(key) + 0.5) / 2^52. Made for reproducible analytics; a private release needs a secret seed and a sampler that is safe in floating point.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: object) -> str:
    return "|".join(map(str, parts))


def uniform(*parts: object) -> float:
    return (int(hashlib.md5(key(*parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def laplace(scale: float, *parts: object) -> float:
    u = uniform(*parts) - 0.5
    return -scale * math.copysign(1.0, u) * math.log(1 - 2 * abs(u))


def normal(*parts: object) -> float:
    return math.sqrt(-2 * math.log(uniform(*parts, "a"))) * math.cos(2 * math.pi * uniform(*parts, "b"))


def laplaces(scale: float, shape: tuple[int, ...], *parts: object) -> np.ndarray:
    """Draws keyed by parts and each position."""
    return np.array([laplace(scale, *parts, *at) for at in np.ndindex(*shape)]).reshape(shape)


def choose(n: int, m: int, *parts: object) -> list[int]:
    """m of range(n) without replacement: those with the smallest draws."""
    return sorted(range(n), key=lambda i: (uniform(*parts, i), i))[:m]


def uniform_col(*parts: object) -> Column:
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def laplace_col(scale: float | Column, *parts: object) -> Column:
    u = uniform_col(*parts) - 0.5
    return -F.lit(scale) * F.signum(u) * F.log(1 - 2 * F.abs(u))


def normal_col(*parts: object) -> Column:
    return F.sqrt(-2 * F.log(uniform_col(*parts, "a"))) * F.cos(2 * math.pi * uniform_col(*parts, "b"))
