"""Noisy counts, sums and proxies."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noisefold.functions import rng, vectors
from noisefold.operators.stats import Sums


def count_scale(eps: float) -> float:
    if eps <= 0:
        raise ValueError("the budget of counts must be positive")
    return 1 / eps


def sum_scale(eps: float, clip: float, d: int) -> float:
    if eps <= 0:
        raise ValueError("the budget of sums must be positive")
    return 2 * clip * math.sqrt(d) / eps


def noisy_centroids(sums: Sums, eps_cnt: float, eps_sum: float, clip: float, reset: np.ndarray | None, *seed: object) -> tuple[np.ndarray, np.ndarray]:
    """Noisy counts and centroids: noisy sum over the noisy count, 1 at least. A cluster whose noisy count isn't positive gets a point of reset and the count 1."""
    k, d = sums.s.shape
    n = sums.n + rng.laplaces(count_scale(eps_cnt), (k,), *seed, "cnt")
    s = sums.s + rng.laplaces(sum_scale(eps_sum, clip, d), (k, d), *seed, "sum")
    c = s / np.maximum(n, 1)[:, None]
    for j in np.flatnonzero(n <= 0):
        if reset is None or not len(reset):
            raise ValueError("an empty cluster needs points to be reset to")
        c[j], n[j] = reset[int(rng.uniform(*seed, "reset", j) * len(reset))], 1.0
    return n, c


def projection(q: int, target: int, *seed: object) -> np.ndarray:
    """q x q' Gaussian projection of variance 1 / q'; the identity for q' = q."""
    width = min(max(int(target), 1), q)
    return np.eye(q) if width == q else np.array([[rng.normal(*seed, "projection", i, j) for j in range(width)] for i in range(q)]) / math.sqrt(width)


def times(df: DataFrame, matrix: np.ndarray, col: str = "features", shift: np.ndarray | None = None) -> DataFrame:
    """Each vector, less shift, times the matrix, in Arrow batches."""
    sent = df.sparkSession.sparkContext.broadcast((np.asarray(matrix, float), None if shift is None else np.asarray(shift, float)))  # model sized

    @F.pandas_udf("array<double>")
    def product(x: pd.Series) -> pd.Series:
        m, less = sent.value
        if not len(x):
            return pd.Series([], dtype=object)
        v = np.stack(x.to_numpy()).astype(float)
        return pd.Series(list((v if less is None else v - less) @ m))

    return df.withColumn(col, product(F.col(col)))


def add_noise(df: DataFrame, scale: float, *seed: object, col: str = "features") -> DataFrame:
    """Laplace noise on every component, keyed by row_id and dimension."""
    noisy = F.transform(col, lambda x, i: x + rng.laplace_col(scale, *seed, F.col("row_id"), i))
    return df.withColumn(col, noisy)


def proxy_facts(r: np.ndarray, eps: float, clip: float) -> dict[str, float]:
    """Public quantities of a proxy under the projection r."""
    if eps <= 0:
        raise ValueError("a proxy needs a positive budget")
    norm = float(np.linalg.norm(r, 2))
    sensitivity = 2 * clip * norm * math.sqrt(r.shape[1])
    return {"proxy_dim": r.shape[1], "proxy_op_norm": norm, "proxy_sensitivity": sensitivity, "proxy_noise_scale": sensitivity / eps}


def proxy(df: DataFrame, target: int, eps: float, clip: float, *seed: object) -> tuple[DataFrame, np.ndarray, dict[str, float]]:
    """Noisy random projection of the rows, the pseudo-inverse that lifts back, and its public quantities."""
    r = projection(len(df.select("features").first()[0]), target, *seed)
    facts = proxy_facts(r, eps, clip)
    return add_noise(times(df, r), facts["proxy_noise_scale"], *seed, "proxy"), np.linalg.pinv(r), facts


def point_noise_proxy(df: DataFrame, eps: float, bound: float, *seed: object) -> DataFrame:
    """Noise of scale 2 * bound / eps on every component and a clip to the box; the rows as they are for eps <= 0."""
    if eps <= 0:
        return df
    return add_noise(df, 2 * bound / eps, *seed).withColumn("features", F.transform("features", lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def clip_rows(points: np.ndarray, most: float) -> np.ndarray:
    return points * np.minimum(1.0, most / np.maximum(np.linalg.norm(points, axis=1), 1e-12))[:, None]


def lift(points: np.ndarray, back: np.ndarray, clip: float) -> np.ndarray:
    return clip_rows(points @ back, clip)


def public_points(n: int, d: int, clip: float, *seed: object) -> np.ndarray:
    """Points in random directions at radii uniform in (0, clip): no data involved."""
    x = np.array([[rng.normal(*seed, "public", i, j) for j in range(d)] for i in range(n)])
    radius = np.array([rng.uniform(*seed, "radius", i) for i in range(n)]) * clip
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) * radius[:, None]


def subsample(df: DataFrame, share: float, least: int, *seed: object) -> DataFrame:
    """Exactly max(share * n, least) rows, those with the smallest keyed draws; all for a share outside (0, 1)."""
    if not 0 < share < 1:
        return df
    n = df.count()
    return df if max(int(n * share), least) >= n else first_by_draw(df, max(int(n * share), least), *seed)


SORTED = 10_000  # rows that may meet in one task or the driver


def first_by_draw(df: DataFrame, n: int, *seed: object) -> DataFrame:
    """The n rows of the smallest keyed draws, ties by row_id. More than SORTED rows are told by a cut, so that none are sorted or shuffled: histograms of the draws find the bucket in which the n-th lies, closer each time, and the draws of a bucket of at most SORTED rows the n-th itself. row_id names a row: rows that share one share its draw, and stay or go together there."""
    drawn = df.withColumn("_u", rng.uniform_col(*seed, F.col("row_id")))
    if n <= SORTED:
        return drawn.orderBy("_u", "row_id").limit(n).drop("_u")
    cut = cuts_by_draw(df, {0: (rng.key(*seed), n)}).get(0)
    return df if cut is None else drawn.where((F.col("_u") < cut[0]) | ((F.col("_u") == cut[0]) & (F.col("row_id") <= cut[1]))).drop("_u")


def cuts_by_draw(df: DataFrame, wanted: Mapping[int, tuple[str, int]], buckets: int = 1024) -> dict[int, tuple[float, int]]:
    """For each name the draw and row_id of the n-th smallest draw under its (key, n), n at least 1; a name with fewer than n rows is left out. All names share the passes: a histogram of buckets a name, then, until they hold few, of the bucket in which the n-th lies."""
    low, size, left = {w: 0.0 for w in wanted}, {w: 1.0 for w in wanted}, {w: n for w, (_, n) in wanted.items()}
    out: dict[int, tuple[float, int]] = {}

    def inside(some: Sequence[int]) -> DataFrame:
        """Draws of the names that lie in their intervals."""
        each = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(wanted[w][0]).alias("key"), F.lit(low[w]).alias("low"), F.lit(size[w]).alias("size")) for w in some)))
        drawn = df.select("row_id", each.alias("x")).select("row_id", "x.*").withColumn("u", rng.uniform_col(F.col("key"), F.col("row_id")))
        return drawn.where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.col("size")))

    going, few = list(wanted), []
    while going:
        found: dict[int, dict[int, int]] = {w: {} for w in going}
        for r in inside(going).groupBy("w", F.floor((F.col("u") - F.col("low")) / F.col("size") * buckets).cast("int").alias("b")).agg(F.count("*").alias("n")).collect():  # a row a bucket
            found[r["w"]][r["b"]] = r["n"]
        nxt = []
        for w in going:
            for b in sorted(found[w]):
                if found[w][b] >= left[w]:
                    low[w], size[w] = low[w] + size[w] * b / buckets, size[w] / buckets
                    (few if found[w][b] <= SORTED or size[w] < 2**-50 else nxt).append(w)
                    break
                left[w] -= found[w][b]
        going = nxt
    if few:
        at = F.element_at(F.create_map(*(F.lit(x) for w in few for x in (w, left[w]))), F.col("w"))
        ranked = inside(few).withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("u", "row_id")))
        out = {r["w"]: (r["u"], r["row_id"]) for r in ranked.where(F.col("r") == at).collect()}
    return out


def prefix_columns(df: DataFrame, d: int) -> DataFrame:
    return df.withColumn("features", vectors.prefix("features", d))
