"""Synthetic blobs and streams, drawn by key: any partitioning gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefold.functions import rng, vectors
from noisefold.operators import ranks


def weights(k: int, given: Sequence[float] | None = None) -> list[float]:
    """Cluster weights that sum to 1; 1 / k each by default."""
    w = [1.0] * k if given is None else [float(x) for x in given]
    if len(w) != k or min(w) < 0 or sum(w) <= 0:
        raise ValueError("weights need k non-negative numbers with a positive sum")
    return [x / sum(w) for x in w]


def blob_counts(n: int, k: int, given: Sequence[float] | None = None) -> list[int]:
    """Rows of each cluster: the floor of its share, 1 at least; the last gets the rest."""
    counts = [max(1, int(n * w)) for w in weights(k, given)]
    counts[-1] += n - sum(counts)
    return counts


def blobs(spark: SparkSession, n: int, d: int, k: int, seed: int = 0, given: Sequence[float] | None = None, deviation: float = 1.0) -> DataFrame:
    """row_id, features, label: Gaussian blobs around centres uniform in (-10, 10)."""
    centres = np.array([[rng.uniform(seed, "centre", c, j) * 20 - 10 for j in range(d)] for c in range(k)])
    label = F.lit(k - 1)
    for c, top in reversed(list(enumerate(np.cumsum(blob_counts(n, k, given))[:-1].tolist()))):
        label = F.when(F.col("row_id") < top, c).otherwise(label)
    rows = spark.range(n).withColumnRenamed("id", "row_id").withColumn("label", label.cast("int"))
    centre = F.element_at(F.array(*(vectors.literal(c) for c in centres)), F.col("label") + 1)
    return rows.select("row_id", F.transform(centre, lambda x, j: x + deviation * rng.normal_col(seed, "point", F.col("row_id"), j)).alias("features"), "label")


def stream(spark: SparkSession, n: int, d: int, k: int, batches: int, seed: int = 0, **how) -> DataFrame:
    """blobs dealt to batch_id 0..batches-1 in a keyed order; the first n % batches batches get one row more."""
    ids, _ = ranks.by_draw(spark.range(n).withColumnRenamed("id", "row_id"), "_place", seed, "order")
    return blobs(spark, n, d, k, seed, **how).join(ids.select("row_id", ranks.tile(F.col("_place"), n, batches).alias("batch_id")), "row_id")
