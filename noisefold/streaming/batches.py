"""Clustering of batches: each batch is clustered on its own with the whole budget, which parallel composition allows, and metrics are averaged."""

from __future__ import annotations

import statistics
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.plans import methods

_AVERAGED = ("f1", "ari", "nmi", "sse_x", "sse_z", "non_empty_k_final", "max_cluster_ratio_final", "min_cluster_ratio_final", "cluster_entropy_final")


def run_batches(df: DataFrame, dataset: str, name: str, k: int, eps: float, seed: int, **config) -> dict:
    """One result row for a frame with batch_id: metrics averaged over batches, times summed, with the deviation (population) of F1 and error."""
    held = df.persist()
    ids = sorted(r["batch_id"] for r in held.select("batch_id").distinct().collect())
    got = [methods.run(held.where(F.col("batch_id") == b).drop("batch_id"), dataset, name, k, eps, seed, **config)[0] for b in ids]
    held.unpersist()
    return summary(got)


def summary(got: list[dict]) -> dict:
    out = dict(got[0])
    for m in _AVERAGED:
        if all(r.get(m) is not None for r in got):
            out[m] = statistics.fmean(r[m] for r in got)
    out["runtime_ms_total"] = sum(r["runtime_ms_total"] for r in got)
    return out | {"stream_batches": len(got), "f1_std": statistics.pstdev(r["f1"] for r in got), "sse_x_std": statistics.pstdev(r["sse_x"] for r in got)}


def cluster_stream(stream: DataFrame, checkpoint: str, done: Callable[[int, dict], None], dataset: str, name: str, k: int, eps: float, seed: int, **config):
    """Start a structured stream whose micro-batches (row_id, features, label) are clustered one by one; done gets each batch's id and result row. A batch that is run again after a failure gives the same row, since all draws are keyed."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            held = batch.persist()
            done(batch_id, methods.run(held, dataset, name, k, eps, seed, **config)[0])
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
