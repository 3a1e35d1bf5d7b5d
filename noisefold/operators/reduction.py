"""Principal components: from the Gram matrix of the rows in one distributed pass, or for wide rows by block power iteration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.functions import rng
from noisefold.operators import noise, prep


def moments(df: DataFrame, col: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (population). A task sends d * (d + 1) sums, d * (d + 1) reach the driver."""
    d = len(df.select(col).first()[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d + 1, d + 1))
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.ones(len(pdf)), np.stack(pdf[col].to_numpy()).astype(float)])
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(d + 1), "row": list(total)})

    rows = df.select(col).mapInPandas(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g = np.zeros((d + 1, d + 1))
    for r in rows:
        g[r["i"], r["j"]] = r["x"]
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    return int(n), mean, g[1:, 1:] / n - np.outer(mean, mean)


def components(covariance: np.ndarray, r: int) -> np.ndarray:
    """d x r leading eigenvectors, the largest loading of each positive."""
    values, vectors = np.linalg.eigh(covariance)
    return _signed(vectors[:, np.argsort(-values, kind="stable")[:r]])


def _signed(v: np.ndarray) -> np.ndarray:
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


WIDE = 1024  # features beyond which the driver and tasks don't hold a Gram matrix


def means(df: DataFrame, col: str = "features") -> tuple[int, np.ndarray]:
    """Rows and mean; a task sends d + 1 sums."""
    d = len(df.select(col).first()[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(d), 0
        for pdf in batches:
            if len(pdf):
                total += np.stack(pdf[col].to_numpy()).astype(float).sum(0)
                n += len(pdf)
        yield pd.DataFrame({"at": np.arange(-1, d), "x": np.concatenate([[n], total])})

    found = {r["at"]: r["x"] for r in df.select(col).mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()}
    return int(found[-1]), np.array([found[j] for j in range(d)]) / found[-1]


def times_covariance(df: DataFrame, q: np.ndarray, n: int, mean: np.ndarray, col: str = "features") -> np.ndarray:
    """The covariance (population) times q (d x l), without the covariance: a task sums its rows' x (x'q), d x l numbers, of which Spark adds up the parts of each feature."""
    sent = df.sparkSession.sparkContext.broadcast((q, mean))  # d x l

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, less = sent.value
        total = np.zeros(m.shape)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[col].to_numpy()).astype(float) - less
                total += x.T @ (x @ m)
        yield pd.DataFrame({"i": np.arange(len(m)), "row": list(total)})

    width = q.shape[1]
    sums = df.select(col).mapInPandas(run, "i int, row array<double>").groupBy("i").agg(*(F.sum(F.col("row")[j]).alias(f"s{j}") for j in range(width))).collect()
    out = np.zeros(q.shape)
    for r in sums:
        out[r["i"]] = [r[f"s{j}"] for j in range(width)]
    sent.unpersist()
    return out / n


def block_components(df: DataFrame, r: int, rounds: int = 50, spare: int = 8, tolerance: float = 1e-9, *seed: object, col: str = "features") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, d x r leading eigenvectors (largest loading positive) and their eigenvalues by block power iteration with `spare` more vectors, for any d: nobody holds d x d.

    A round is a pass over the rows (keep them persisted) and ends when all r eigenvalues and their residuals move by less than the tolerance times the largest; the block is orthogonal again after each. Eigenvectors turn to the exact ones by the ratio of their eigenvalue to the (r + spare + 1)-th a round, so nearly equal ones there take all rounds and are mixed with each other.
    """
    n, mean = means(df, col)
    d = len(mean)
    width = min(d, r + spare)
    start = np.random.default_rng(int(rng.uniform(*seed, "block") * 2**52)).standard_normal((d, width))
    q = np.linalg.qr(start)[0]
    for _ in range(rounds):
        z = times_covariance(df, q, n, mean, col)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)  # Rayleigh and Ritz: the best of the block's span
        order = np.argsort(-values, kind="stable")[: min(r, d)]
        values, turn = values[order], turn[:, order]
        vectors = q @ turn
        off = np.sqrt(((z @ turn - vectors * values) ** 2).sum(0)).max(initial=0.0)
        if width == d or off <= tolerance * max(abs(values[0]), 1e-300):
            break
        q = np.linalg.qr(z)[0]
    return mean, _signed(vectors), values


def leading(df: DataFrame, r: int, *seed: object, col: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Mean and d x r leading components: exact for up to WIDE features, else by block power iteration."""
    if len(df.select(col).first()[0]) <= WIDE:
        _, mean, cov = moments(df, col)
        return mean, components(cov, min(r, len(mean)))
    held = df.select(col).persist()
    mean, v, _ = block_components(held, r, 50, 8, 1e-9, *seed, col=col)
    held.unpersist()
    return mean, v


def pca(df: DataFrame, r: int = 50, col: str = "features") -> DataFrame:
    """Centred projection to the r leading components (min(r, d))."""
    mean, v = leading(df, r, "pca", col=col)
    return noise.times(df, v, col, mean)


def pca_scale(eps: float, clip: float, d: int) -> float:
    """Noise of each component of rows whose length is at most clip."""
    if eps <= 0:
        raise ValueError("noisy components need a positive budget")
    return 2 * clip * math.sqrt(d) / eps


def noisy_pca(df: DataFrame, r: int, eps: float, clip: float, *seed: object) -> tuple[DataFrame, dict[str, float]]:
    """Components fitted on rows with noise, clean rows projected, clipped. With r >= d only the clip, and no budget spent."""
    d = len(df.select("features").first()[0])
    if r >= d:
        return prep.row_clip(df, clip), {"pca_noise_scale": 0.0, "pca_sensitivity": 0.0}
    scale = pca_scale(eps, clip, d)
    mean, v = leading(noise.add_noise(df, scale, *seed, "pca"), r, *seed)
    return prep.row_clip(noise.times(df, v, "features", mean), clip), {"pca_noise_scale": scale, "pca_sensitivity": scale * eps}
