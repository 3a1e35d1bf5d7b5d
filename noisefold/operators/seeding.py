"""Initial centroids. The rows stay distributed; centroids are model sized."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.functions import rng
from noisefold.operators import noise, ranks, stats


def random_rows(df: DataFrame, k: int, *seed: object) -> np.ndarray:
    return np.array([r["features"] for r in noise.first_by_draw(df, k, *seed, "rows").orderBy("row_id").collect()])


def kmeanspp(df: DataFrame, k: int, *seed: object) -> np.ndarray:
    """k-means++: each round takes a row with probability in proportion to its squared distance, as the row of the largest ln(u) / d^2. A round is one pass: distances to the picks so far (k * d numbers, broadcast) in Arrow batches, and one aggregate."""
    spark = df.sparkSession
    first = df.select("row_id", "features", rng.uniform_col(*seed, "pp", 0, F.col("row_id")).alias("u")).agg(F.min_by("features", F.struct("u", "row_id")).alias("c")).first()["c"]
    picks = [first]
    for t in range(1, k):
        sent = spark.sparkContext.broadcast(np.array(picks, float))

        @F.pandas_udf("double")
        def near(x: pd.Series) -> pd.Series:
            rows, out = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1)), np.full(len(x), np.inf)
            for c in sent.value if len(x) else ():  # noqa: B023
                np.minimum(out, ((rows - c) ** 2).sum(1), out=out)
            return pd.Series(out)

        weight = F.when(F.col("d") > 0, F.log(F.col("u")) / F.col("d")).otherwise(F.lit(float("-inf")))
        row = df.select("row_id", "features", near("features").alias("d"), rng.uniform_col(*seed, "pp", t, F.col("row_id")).alias("u")).agg(F.max_by("features", F.struct(weight.alias("w"), -F.col("row_id"))).alias("c")).first()
        picks.append(row["c"])
        sent.unpersist()
    return np.array(picks, float)


def kmeanspp_best(df: DataFrame, k: int, restarts: int, *seed: object) -> np.ndarray:
    """The restart with the smallest squared error, the first of equals."""
    tries = [kmeanspp(df, k, *seed, "restart", r) for r in range(max(int(restarts), 1))]
    return min(tries, key=lambda c: stats.cluster_sums(df, c).sse(c))


def fuzzy(df: DataFrame, k: int, *seed: object, rows: int = 3000, rounds: int = 50, power: float = 2.0) -> np.ndarray:
    """Fuzzy c-means from a k-means++ start on at most `rows` rows by keyed draw, which fit the driver."""
    some = noise.first_by_draw(df, rows, *seed, "fuzzy")
    c = kmeanspp(some, k, *seed, "fuzzy")
    return fuzzy_rounds(np.array([r["features"] for r in some.select("features").collect()], float), c, rounds, power)


def fuzzy_rounds(x: np.ndarray, c: np.ndarray, rounds: int = 50, power: float = 2.0) -> np.ndarray:
    for _ in range(rounds):
        near = (np.sqrt(((x[:, None] - c[None]) ** 2).sum(2)) + 1e-8) ** (-2 / (power - 1))
        weight = (near / near.sum(1, keepdims=True)) ** power
        c = weight.T @ x / (weight.sum(0)[:, None] + 1e-9)
    return c


def fuzzy_means(df: DataFrame, c: np.ndarray, rounds: int = 50, power: float = 2.0) -> np.ndarray:
    """Fuzzy c-means over all rows from given centroids: a round is one aggregation of soft memberships, no row reaches the driver. Without rows the centroids become zero, as without weight."""
    for _ in range(rounds):
        weight, total = stats.soft_sums(df, c, power)
        c = total / (weight[:, None] + 1e-9)
    return c


def proxy_stats(df: DataFrame, centroids: np.ndarray) -> dict[str, float]:
    sums = stats.cluster_sums(df, centroids)
    return {"sse": sums.sse(centroids)} | sums.shape()


def layered_score(s: dict[str, float], k: int, cfg: dict) -> float:
    """Squared error, raised for small, dominant and empty clusters."""
    low, high = cfg.get("min_cluster_ratio", 1 / max(3 * k, 1)), cfg.get("max_cluster_ratio", 0.75)
    penalty = max(0.0, low - s["min_ratio"]) * cfg.get("w_min_ratio", 2.0) + max(0.0, s["max_ratio"] - high) * cfg.get("w_max_ratio", 1.5) + max(0.0, k - s["non_empty"]) / max(k, 1) * cfg.get("w_empty", 3.0)
    return s["sse"] * (1 + penalty)


def wants_fuzzy(s: dict[str, float], k: int, cfg: dict) -> bool:
    """Whether restarts that gave these statistics look collapsed, and a fallback is allowed."""
    collapsed = s["non_empty"] < k or s["min_ratio"] < cfg.get("min_cluster_ratio", 1 / max(3 * k, 1)) or s["max_ratio"] > cfg.get("max_cluster_ratio", 0.75)
    return bool(cfg.get("use_fuzzy_fallback", True) and collapsed)


def layered(df: DataFrame, k: int, *seed: object, cfg: dict | None = None, restarts: int = 10) -> np.ndarray:
    """Restarts first; where their clusters look collapsed, fuzzy c-means if it scores better by the margin."""
    cfg = cfg or {}
    light = kmeanspp_best(df, k, max(int(cfg.get("rr_restarts_light", restarts)), 1), *seed)
    s = proxy_stats(df, light)
    if not wants_fuzzy(s, k, cfg):
        return light
    heavy = fuzzy(df, k, *seed)
    return heavy if layered_score(proxy_stats(df, heavy), k, cfg) + cfg.get("switch_margin", 0.0) < layered_score(s, k, cfg) else light


def noisy_means(df: DataFrame, k: int, eps: float, clip: float, *seed: object) -> np.ndarray:
    """Means of k random equal parts with noisy counts and sums, clipped."""
    ranked, n = ranks.by_draw(df, "_r", *seed, "parts")
    parts = ranked.withColumn("cluster", F.least(F.floor(F.col("_r") * k / max(n, 1)), F.lit(k - 1)).cast("int"))
    _, c = noise.noisy_centroids(stats.sums_by(parts, "cluster", k), eps / 2, eps / 2, clip, noise.public_points(k, len(df.select("features").first()[0]), clip, *seed), *seed, "means")
    return noise.clip_rows(c, clip)


def initial(mode: str, df: DataFrame | None, back: np.ndarray | None, k: int, d: int, clip: float, *seed: object, restarts: int = 10, cfg: dict | None = None) -> np.ndarray:
    """Centroids by mode: public_random needs no data; kpp, kpp_rr and layered seed on the proxy and lift."""
    if mode == "public_random":
        return noise.public_points(k, d, clip, *seed, "init")
    if df is None or back is None:
        raise ValueError("this seeding needs a proxy and its pseudo-inverse")
    if mode == "kpp":
        c = kmeanspp(df, k, *seed)
    elif mode == "kpp_rr":
        c = kmeanspp_best(df, k, restarts, *seed)
    elif mode == "layered":
        c = layered(df, k, *seed, cfg=cfg, restarts=restarts)
    else:
        raise ValueError(f"unknown seeding: {mode}")
    return noise.lift(c, back, clip)
