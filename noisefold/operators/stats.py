"""Assignment to centroids and the sufficient statistics of clusters: one pass over the rows, k * d sums out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid, ties to the lowest, a bounded slab of distances at a time."""
    out = np.empty(len(x), np.int64)
    step = max(1, (1 << 21) // max(1, c.size))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        out[at : at + step] = ((part[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
    return out


def assign(df: DataFrame, centroids: np.ndarray, name: str = "cluster", col: str = "features") -> DataFrame:
    """df with the nearest centroid of each row, in Arrow batches."""
    sent = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))  # k * d numbers

    @F.pandas_udf("int")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(x.to_numpy()).astype(float), sent.value) if len(x) else [], dtype="int32")

    return df.withColumn(name, of(F.col(col)))


@dataclass
class Sums:
    """Rows n, vector sums s and sums of squared lengths q of each cluster."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray

    def sse(self, centroids: np.ndarray) -> float:
        """Squared error of the rows against these centroids."""
        return float((self.q - 2 * (centroids * self.s).sum(1) + self.n * (centroids**2).sum(1)).sum())

    def sse_own(self) -> float:
        """Squared error against the clusters' own means."""
        full = self.n > 0
        return float((self.q[full] - (self.s[full] ** 2).sum(1) / self.n[full]).sum())

    def means(self) -> np.ndarray:
        return self.s / np.maximum(self.n, 1)[:, None] * (self.n > 0)[:, None]

    def shape(self) -> dict[str, float]:
        """non_empty, max_ratio, min_ratio, entropy (natural logarithm) of the sizes; zeros for no rows."""
        total = self.n.sum()
        if not total:
            return {"non_empty": 0, "max_ratio": 0.0, "min_ratio": 0.0, "entropy": 0.0}
        p = self.n / total
        return {"non_empty": int((self.n > 0).sum()), "max_ratio": float(p.max()), "min_ratio": float(p.min()), "entropy": float(-(p[p > 0] * np.log(p[p > 0])).sum())}


def cluster_sums(df: DataFrame, centroids: np.ndarray, col: str = "features") -> Sums:
    """The sufficient statistics of the clusters of nearest centroids. Every task adds up its own rows first; k * (d + 2) numbers reach the driver."""
    c = np.asarray(centroids, float)
    k, d = c.shape
    sent = df.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, total = sent.value, np.zeros((k, d + 2))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[col].to_numpy()).astype(float)
                at = _nearest(x, c)
                one = np.zeros((len(x), k))
                one[np.arange(len(x)), at] = 1
                total += one.T @ np.column_stack([np.ones(len(x)), (x * x).sum(1), x])
        full = np.flatnonzero(total[:, 0])
        yield pd.DataFrame({"cluster": full.astype(np.int32), "sums": pd.Series(list(total[full]), dtype=object)})  # of a task without rows, too

    parts = df.select(col).mapInPandas(run, "cluster int, sums array<double>")
    rows = parts.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((k, d + 2))
    for r in rows:
        out[r["cluster"], r["i"]] = r["x"]
    return Sums(out[:, 0], out[:, 2:], out[:, 1])


def soft_sums(df: DataFrame, centroids: np.ndarray, power: float = 2.0, col: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights (k) and of weighted rows (k * d), where a row's weight in a cluster is its fuzzy membership to `power`. One pass: tasks add up their own rows, a slab of memberships at a time, and k * (d + 1) numbers reach the driver."""
    c = np.asarray(centroids, float)
    k, d = c.shape
    sent = df.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, total = sent.value, np.zeros((k, d + 1))
        step = max(1, (1 << 21) // max(1, c.size))
        for pdf in batches:
            for at in range(0, len(pdf), step):
                x = np.stack(pdf[col].iloc[at : at + step].to_numpy()).astype(float)
                near = (np.sqrt(((x[:, None] - c[None]) ** 2).sum(2)) + 1e-8) ** (-2 / (power - 1))
                total += ((near / near.sum(1, keepdims=True)) ** power).T @ np.column_stack([np.ones(len(x)), x])
        yield pd.DataFrame({"cluster": np.arange(k, dtype=np.int32), "sums": pd.Series(list(total), dtype=object)})

    parts = df.select(col).mapInPandas(run, "cluster int, sums array<double>")
    rows = parts.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect()
    sent.unpersist()
    out = np.zeros((k, d + 1))
    for r in rows:
        out[r["cluster"], r["i"]] = r["x"]
    return out[:, 0], out[:, 1:]


def sums_by(df: DataFrame, by: str, k: int, col: str = "features") -> Sums:
    """The statistics of clusters named by a column 0..k-1, with built-in aggregates."""
    long = df.select(by, F.posexplode(col).alias("dim", "x"))
    rows = long.groupBy(by, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).collect()
    d = 1 + max((r["dim"] for r in rows), default=-1)
    out = Sums(np.zeros(k), np.zeros((k, d)), np.zeros(k))
    for r in rows:
        if 0 <= r[by] < k:
            out.n[r[by]], out.s[r[by], r["dim"]] = r["n"], r["s"]
            out.q[r[by]] += r["q"]
    return out


def cluster_table(df: DataFrame, k: int, by: str = "cluster") -> DataFrame:
    """cluster, n, ratio for each of 0..k-1, empty ones with zero."""
    n = df.groupBy(F.col(by).alias("cluster")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    total = df.agg(F.count("*").alias("total"))  # one row
    return every.join(F.broadcast(n), "cluster", "left").crossJoin(F.broadcast(total)).select("cluster", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1))).alias("ratio"))


def diagnostics(table: DataFrame) -> DataFrame:
    """non_empty_k, max_cluster_ratio, min_cluster_ratio, cluster_entropy of a cluster table: one row."""
    p = F.col("ratio")
    return table.agg(F.sum((F.col("n") > 0).cast("long")).alias("non_empty_k"), F.max(p).alias("max_cluster_ratio"), F.min(p).alias("min_cluster_ratio"), F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("cluster_entropy"))


def features(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """row_id, features (doubles) and label of a table with an array column."""
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast(T.IntegerType())
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).cast("array<double>").alias("features"), label.alias("label"))
