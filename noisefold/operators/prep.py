"""Feature preparation: standardise, clip, select, relabel. Frames have row_id, features and mostly label."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.functions import rng, vectors
from noisefold.operators import ranks

TAU = 1e-6


def dimension_stats(df: DataFrame, col: str = "features") -> DataFrame:
    """dim, mean, variance and deviation (population) of each component, aggregated before the shuffle."""
    x = df.select(F.posexplode(col).alias("dim", "x"))
    return x.groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.stddev_pop("x").alias("sd"))


def standardise(df: DataFrame, bound: float = 3.0, col: str = "features") -> DataFrame:
    """(x - mean) / deviation per component, a constant component divided by 1, clipped to [-bound, bound]. The statistics are a row per component."""
    stats = dimension_stats(df, col).orderBy("dim").collect()
    mean, sd = vectors.literal([r["mean"] for r in stats]), vectors.literal([r["sd"] if r["sd"] > 0 else 1.0 for r in stats])
    centred = F.zip_with(col, mean, lambda x, m: x - m)
    scaled = F.zip_with(centred, sd, lambda x, s: F.greatest(F.lit(-bound), F.least(F.lit(bound), x / s)))
    return df.withColumn(col, scaled)


def row_clip(df: DataFrame, most: float, col: str = "features") -> DataFrame:
    return df.withColumn(col, vectors.l2_clip(col, most))


def feature_scores(df: DataFrame, bound: float = 3.0, tau: float = TAU, col: str = "features") -> DataFrame:
    """dim, score: variance over the public cost 2 * bound + tau, clipped to the public maximum."""
    cost = 2 * bound + tau
    return dimension_stats(df, col).select("dim", F.greatest(F.lit(0.0), F.least(F.col("var") / cost, F.lit(bound**2 / cost))).alias("score"))


def variance_sensitivity(rows: int, bound: float = 3.0) -> float:
    if rows <= 0:
        raise ValueError("the table is empty")
    return 8 * bound**2 / rows


def noisy_top(scores: np.ndarray, m: int, eps: float, sensitivity: float, most: float, *seed: object) -> list[int]:
    """m rounds of report-noisy-max with fresh noise on the scores that are left, in the order picked."""
    d = len(scores)
    if m <= 0 or m >= d:
        return list(range(d)) if m > 0 else []
    if eps <= 0:
        raise ValueError("noisy selection needs a positive budget")
    held, left, out = np.clip(scores, 0, most), list(range(d)), []
    scale = 2 * sensitivity / max(eps / m, 1e-12)
    for r in range(m):
        best = max(left, key=lambda i: (held[i] + rng.laplace(scale, *seed, r, i), -i))
        out.append(best)
        left.remove(best)
    return out


def noisy_choice(scores: np.ndarray, rows: int, m: int, eps: float, *seed: object, bound: float = 3.0, tau: float = TAU) -> tuple[list[int], dict[str, float]]:
    """Positions of a noisy choice of m components by score, and its public quantities."""
    cost = 2 * bound + tau
    meta = {"score_sensitivity": variance_sensitivity(rows, bound) / (cost + tau), "score_max": bound**2 / cost}
    return noisy_top(scores, m, eps, meta["score_sensitivity"], meta["score_max"], *seed), meta


def select_noisy(df: DataFrame, m: int, eps: float, *seed: object, bound: float = 3.0, tau: float = TAU, col: str = "features") -> tuple[DataFrame, list[int], dict[str, float]]:
    """Noisy choice of m components by score: the frame with those components, their positions, and the public quantities."""
    scores = np.array([r["score"] for r in feature_scores(df, bound, tau, col).orderBy("dim").collect()])
    picked, meta = noisy_choice(scores, df.count(), m, eps, *seed, bound=bound, tau=tau)
    return (df if m >= len(scores) else df.withColumn(col, vectors.gather(col, picked))), picked, meta


def select_random(df: DataFrame, m: int, *seed: object, col: str = "features") -> tuple[DataFrame, list[int]]:
    d = len(df.select(col).first()[0])
    picked = sorted(rng.choose(d, min(m, d), *seed))
    return df.withColumn(col, vectors.gather(col, picked)), picked


def select_widest(df: DataFrame, m: int = 100, col: str = "features") -> tuple[DataFrame, list[int]]:
    """The m components of largest variance, in descending order, ties to the later one."""
    picked = [r["dim"] for r in dimension_stats(df, col).orderBy(F.desc("var"), F.desc("dim")).limit(m).collect()]
    return df.withColumn(col, vectors.gather(col, picked)), picked


def relabel(df: DataFrame, col: str = "label") -> DataFrame:
    """Labels as 0..K-1 in ascending order (a noise label -1 becomes 0); rows without one go. Labels may be as many as rows."""
    names = ranks.distinct_values(df, col, "_new")
    return df.join(names, col).withColumn(col, F.col("_new").cast("int")).drop("_new")
