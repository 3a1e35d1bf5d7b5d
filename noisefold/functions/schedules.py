"""Privacy-budget schedules and the controllers that set a step's budget from the last step's drift. Scalars on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def static(total: float, steps: int) -> list[float]:
    return [total / steps] * steps


def _exact(values: np.ndarray, total: float) -> list[float]:
    """The last entry absorbs what rounding left."""
    values[-1] += total - values.sum()
    return values.tolist()


def strong_contrast(total: float, steps: int, low_share: float = 0.7, low_ratio: float = 0.7) -> list[float]:
    """The first low_share of the steps spend low_ratio of the mean each, the others share the rest; uniform where that is impossible."""
    if steps <= 0 or total <= 0:
        raise ValueError("total and steps must be positive")
    mean, n = total / steps, min(max(int(round(min(max(low_share, 0.0), 1.0) * steps)), 0), steps)
    rest = total - n * low_ratio * mean
    if n in (0, steps) or rest <= 0:
        return _exact(np.full(steps, mean), total)
    out = np.where(np.arange(steps) < n, low_ratio * mean, rest / (steps - n))
    if (out <= 0).any():
        raise ValueError("the schedule has a step without budget")
    return _exact(out, total)


def fixed_tail(total: float, steps: int, low: float = 1.0, high: float = 3.0) -> list[float]:
    """Weights from low to high in equal steps, scaled to the total; no entry below 1e-6."""
    if steps <= 0 or total <= 0:
        raise ValueError("total and steps must be positive")
    w = np.maximum(np.linspace(low, high, steps), 1e-6)
    return np.maximum(_exact(w / (w.sum() + 1e-12) * total, total), 1e-6).tolist()


def project(raw: np.ndarray, total: float, least: float, most: float) -> np.ndarray:
    """raw clipped to [least, most] and scaled to the total."""
    out = np.clip(raw, least, most)
    if out.sum() <= 0:
        return np.full(len(out), total / max(len(out), 1))
    return np.array(_exact(out / out.sum() * total, total))


def remaining_after(schedule: list[float]) -> list[float]:
    """Sum of each entry and all that follow."""
    return np.cumsum(schedule[::-1])[::-1].tolist()


def rescaled(spent: list[float], total: float) -> list[float]:
    f = total / (sum(spent) + 1e-12)
    return [x * f for x in spent]


@dataclass(frozen=True)
class FeedbackRule:
    """How a feedback controller turns smoothed drift into a step's budget.

    Ratios are of the mean budget of a step. power 0 means no base ramp: the gain moves the budget between least and most. With a ramp, the base is multiplied by a clipped gain; `rising` gains grow with drift, others fall. time_power tilts the ramp's tail to late steps.
    """

    least: float
    most: float
    drift_clip: float
    power: float = 0.0
    time_power: float = 0.0
    rising: bool = False
    gain_low: float = 0.0
    gain_high: float = 1.0
    recovery: float = 0.0
    signed: bool = False
    warmup: int = 3
    beta: float = 0.8
    gamma: float = 1.0


# The defaults of the three controllers.
RULES = {
    "feedback": FeedbackRule(least=0.2, most=2.0, drift_clip=2.0),
    "feedback_v2": FeedbackRule(least=0.2, most=2.0, drift_clip=2.0, power=2.0, gain_low=0.7, gain_high=1.3, recovery=-0.5, signed=True),
    "feedback_v3": FeedbackRule(least=0.6, most=3.0, drift_clip=3.0, power=2.5, time_power=3.0, rising=True, gain_low=1.0, gain_high=2.0, recovery=1.0),
}


@dataclass
class Feedback:
    """A controller over a run of `steps` steps; it plans from drift alone and doesn't know what is left."""

    total: float
    steps: int
    rule: FeedbackRule
    smoothed: float = 0.0
    drift: float = 0.0
    step: int = 0
    planned: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.steps <= 0 or self.total <= 0:
            raise ValueError("total and steps must be positive")
        r, self.mean = self.rule, self.total / self.steps
        self.least, self.most = r.least * self.mean, r.most * self.mean
        ramp = self.least + (self.most - self.least) * (np.arange(self.steps) / max(self.steps - 1, 1)) ** r.power
        start = min(r.warmup, self.steps)
        if r.time_power and start < self.steps:
            tilt = (np.linspace(0, 1, self.steps - start) + 1e-6) ** r.time_power
            ramp[start:] *= tilt / (tilt.mean() + 1e-12)
        self.base = ramp

    def next(self) -> dict[str, float]:
        """The next step's budget `eps`, and raw, base and adj as a history row has them."""
        r, t = self.rule, self.step
        self.smoothed = r.beta * self.smoothed + (1 - r.beta) * (self.drift if t else 0.0)
        pull = self.smoothed / max(r.gamma, 1e-6)
        gain = 1 + pull if r.rising else 1 / (1 + pull)
        warm = t < r.warmup
        if not r.power:
            raw = self.least if warm else self.least + (self.most - self.least) * gain
            eps, base, adj = raw, raw, 1.0
        else:
            adj, base = min(max(gain, r.gain_low), r.gain_high), float(self.base[t])
            raw = (max(self.least, self.mean) if r.rising else self.least) if warm else base * adj
            eps = min(max(raw, self.least), self.most) if r.rising else raw
        self.step += 1
        self.planned.append(eps)
        return {"eps": eps, "raw": raw, "base": base, "adj": adj}

    def observe(self, drift: float, norm: float, non_empty: int, max_ratio: float, k: int) -> None:
        r = self.rule
        collapse = max(0.0, (k - non_empty) / max(k, 1)) + max(0.0, max_ratio - 0.6)
        value = drift / (norm + 1e-6) + r.recovery * collapse
        self.drift = min(max(value, -r.drift_clip if r.signed else 0.0), r.drift_clip)


@dataclass
class Guard:
    """Lets feedback raise a step above the static share only after drift fell and without signs of collapse."""

    warmup: int
    improve: float = 0.02
    non_empty_ratio: float = 0.7
    max_ratio: float = 0.6
    cap: float = 1.2

    def decide(self, t: int, candidate: float, static_share: float, drifts: list[float], ratios: list[tuple[float, float]]) -> tuple[float, str]:
        if t < self.warmup:
            return static_share, "warmup_static"
        better = bool(drifts) and (len(drifts) == 1 or drifts[-1] <= drifts[-2] * (1 - self.improve))
        risky = bool(ratios) and (ratios[-1][0] < self.non_empty_ratio or ratios[-1][1] > self.max_ratio)
        if better and not risky and candidate > static_share:
            return min(candidate, static_share * self.cap), "feedback_raise"
        return static_share, "fallback_static"
