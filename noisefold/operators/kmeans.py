"""Noisy k-means: Lloyd steps on noisy counts and sums under a privacy budget.

A step needs one distributed pass: the sufficient statistics under the current centroids. They give this step's noisy centroids, the error of the old assignment, and, since the centroids don't change between, the error after the last step's reassignment. So T steps are T + 1 passes over the rows, which should be persisted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from noisefold.functions import schedules
from noisefold.operators import noise, stats

HISTORY = "iter int, sse_z double, sse_z_prev_labels double, sse_z_reassign double, drift double, drift_raw double, eps_used double, eps_candidate double, eps_raw double, eps_base double, adj double, eps_static_ref double, guard_state string, eps_cnt double, eps_sum double, non_empty_k int, max_cluster_ratio double, min_cluster_ratio double, noise_scale_counts double, noise_scale_sums double, eps_t double"


@dataclass
class Fit:
    centroids: np.ndarray
    history: list[dict]
    final: stats.Sums  # under the final centroids

    def history_frame(self, spark: SparkSession) -> DataFrame:
        names = [f.split()[0] for f in HISTORY.split(", ")]
        return spark.createDataFrame([tuple(h[n] for n in names) for h in self.history], HISTORY)


def dp_kmeans(df: DataFrame, init: np.ndarray, steps: int, eps: float, clip: float, *seed: object, **how) -> Fit:
    """At most `steps` noisy steps on df.features within the budget eps; stops when it is spent. Options are those of lloyd()."""
    return drive([lloyd(init, steps, eps, clip, *seed, **how)], lambda asked: [stats.cluster_sums(df, c) for _, c in asked])[0]


def drive(fits: Sequence[Generator[np.ndarray, stats.Sums, Fit]], sums: Callable[[list[tuple[int, np.ndarray]]], list[stats.Sums]]) -> list[Fit]:
    """Run lloyd() generators together: what those that still ask want, (which, centroids) each, is answered by one call of sums."""
    done: list[Fit | None] = [None] * len(fits)
    asked = [(i, next(f)) for i, f in enumerate(fits)]
    while asked:
        answers, nxt = sums(asked), []
        for (i, _), got in zip(asked, answers):
            try:
                nxt.append((i, fits[i].send(got)))
            except StopIteration as e:
                done[i] = e.value
        asked = nxt
    return done


def lloyd(init: np.ndarray, steps: int, eps: float, clip: float, *seed: object, mode: str = "static", schedule: list[float] | None = None, rule: dict | None = None, guard: schedules.Guard | None = None, reset: np.ndarray | None = None, boost: float = 1.3, boost_above: float = 0.55, cap: float | None = None, count_share: float = 0.2) -> Generator[np.ndarray, stats.Sums, Fit]:
    """The steps without the rows: yields centroids, is sent the sums of the clusters nearest to them, and returns the fit.

    mode is static, feedback, feedback_v2 or feedback_v3, unless an explicit schedule is given: that is rescaled to what is left at each step, and raised by boost where a cluster is empty or holds more than boost_above of the rows. reset are the points for clusters whose noisy count isn't positive (the initial centroids by default).
    """
    if schedule is not None and len(schedule) != steps:
        raise ValueError("the schedule must have an entry for each step")
    control = None
    if schedule is None and mode != "static":
        import dataclasses

        control = schedules.Feedback(eps, steps, dataclasses.replace(schedules.RULES[mode], **(rule or {})))
    planned = schedule if schedule is not None else schedules.static(eps, steps)
    after = schedules.remaining_after(planned)
    c, left = np.array(init, float), float(eps)
    k, d = c.shape
    spare = c.copy() if reset is None else reset
    sums = yield c
    history: list[dict] = []
    ratios: list[tuple[float, float]] = []
    for t in range(steps):
        if left <= 1e-12:
            break
        share = left / (steps - t)
        if schedule is not None:
            raw = planned[t] * (left / after[t] if after[t] > 0 else 0.0)
            eps_now, candidate, base, adj, state = raw, raw, planned[t], 1.0, "scheduled"
        elif control is None:
            eps_now = candidate = raw = base = planned[t]
            adj, state = 1.0, "static"
        else:
            plan = control.next()
            eps_now, candidate, raw, base, adj, state = plan["eps"], plan["eps"], plan["raw"], plan["base"], plan["adj"], "feedback"
            if guard is not None:
                eps_now, state = guard.decide(t, candidate, share, [h["drift"] for h in history[-2:]], ratios)
        shape = sums.shape()
        if schedule is not None and (shape["non_empty"] < k or shape["max_ratio"] > boost_above):
            eps_now *= boost
        if cap is not None:
            eps_now = min(eps_now, cap)
        eps_now = min(max(eps_now, 1e-8), left)
        eps_cnt = max(eps_now * count_share, 1e-8)
        eps_sum = max(eps_now - eps_cnt, 1e-8)
        counts, new = noise.noisy_centroids(sums, eps_cnt, eps_sum, clip, spare, *seed, t)
        total = float(counts.sum())
        weight = np.sqrt(counts / ((total if math.isfinite(total) and total > 0 else float(sums.n.sum())) + 1e-12))[:, None]
        drift = float(np.linalg.norm((new - c) * weight))
        nxt = yield new
        old_error = sums.sse(new)
        history.append(
            {
                "iter": t, "sse_z": old_error, "sse_z_prev_labels": old_error, "sse_z_reassign": nxt.sse(new), "drift": drift, "drift_raw": float(np.linalg.norm(new - c)),
                "eps_used": eps_now, "eps_candidate": candidate, "eps_raw": raw, "eps_base": base, "adj": adj, "eps_static_ref": share, "guard_state": state, "eps_cnt": eps_cnt, "eps_sum": eps_sum,
                "non_empty_k": shape["non_empty"], "max_cluster_ratio": shape["max_ratio"], "min_cluster_ratio": shape["min_ratio"], "noise_scale_counts": noise.count_scale(eps_cnt), "noise_scale_sums": noise.sum_scale(eps_sum, clip, d), "eps_t": eps_now,
            }
        )
        ratios.append((shape["non_empty"] / max(k, 1), shape["max_ratio"]))
        if control is not None:
            control.observe(drift, float(np.linalg.norm(new * weight)), shape["non_empty"], shape["max_ratio"], k) if mode != "feedback" else control.observe(drift, float(np.linalg.norm(new * weight)), k, 0.0, k)
        left, c, sums = max(left - eps_now, 0.0), new, nxt
    return Fit(c, history, sums)
