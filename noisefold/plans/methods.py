"""Named methods: which steps they take, how the privacy budget is split, and one run from rows to a result row.

Features are standardised, reduced, seeded on a noisy proxy and clustered; every stage draws from the budget, and what the run spent is in its result. Standardisation uses exact moments, counts have the scale of one changed record per cluster, and feedback reads exact counts, so the guarantee is that of the noise steps, not of the whole; `privacy_audit` says so in each result.
"""

from __future__ import annotations

import time
from collections.abc import Generator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.functions import schedules
from noisefold.operators import kmeans, metrics, noise, prep, reduction, seeding, stats
from noisefold.sources import runs, storage, tables


@dataclass(frozen=True)
class Method:
    features: str = "none"  # none, noisy, random
    pca: bool = False
    init: str = "public_random"  # public_random, kpp, kpp_rr, layered
    budget: str = "static"  # static, feedback, feedback_v2, feedback_v3
    schedule: str | None = None  # strong, tail
    feedback: Mapping[str, object] = field(default_factory=dict)


# The methods by name.
METHODS = {
    "dpk": Method(),
    "dpk_kpp": Method(init="kpp"),
    "dpk_pca": Method(pca=True, init="kpp"),
    "dpk_full": Method("noisy", True, "layered", "feedback_v3"),
    "dpk_no_select": Method("none", True, "layered", "feedback_v3"),
    "dpk_no_init": Method("noisy", True, "kpp", "feedback_v3"),
    "dpk_no_feedback": Method("noisy", True, "layered"),
    "dpk_strong": Method("noisy", True, "layered", schedule="strong"),
    "dpk_fb_v3": Method("noisy", True, "layered", "feedback_v3"),
    "dpk_fb_v2": Method("noisy", True, "layered", "feedback_v2", feedback={"recovery": 0.0}),
    "dpk_proxy_kpp": Method("noisy", True, "kpp", "feedback_v3"),
    "dpk_proxy_rr": Method("noisy", True, "kpp_rr", "feedback_v3"),
    "dpk_pca_only": Method("none", True, "layered", "feedback_v3"),
    "dpk_random_features": Method("random", False, "layered", "feedback_v3"),
}


def merged(*configs: Mapping) -> dict:
    """Nested mappings joined key by key; later ones win."""
    out: dict = {}
    for c in configs:
        for k, v in c.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


_OWN = ("features", "pca", "init", "budget", "schedule", "feedback")


def split_overrides(overrides: Mapping) -> tuple[dict, dict]:
    """Overrides of the method itself, and those of the run's parameters."""
    return {k: v for k, v in overrides.items() if k in _OWN}, {k: v for k, v in overrides.items() if k not in _OWN}


def resolve(name: str, overrides: Mapping | None = None) -> Method:
    """The named method (an unknown name is the plainest one) with overrides."""
    m = METHODS.get(name, Method())
    own, _ = split_overrides(overrides or {})
    if "feedback" in own:
        own["feedback"] = {**m.feedback, **own["feedback"]}
    return replace(m, **own)


def budget_split(eps: float, noisy_features: bool, pca: bool, proxy_ratio: float) -> dict[str, float]:
    """Shares of the budget: 5 % for reduction where any is done (60 % of it for selection, the rest for components), the proxy's ratio, the rest for iterations. Shares that leave nothing are scaled to 85 %."""
    reduce_, proxy = 0.05 * eps * (noisy_features or pca), proxy_ratio * eps
    if reduce_ + proxy >= eps:
        f = 0.85 * eps / (reduce_ + proxy)
        reduce_, proxy = reduce_ * f, proxy * f
    top = 0.6 * reduce_ * noisy_features
    components = (reduce_ - top) * pca
    return {"eps_fs": reduce_, "eps_topm": top, "eps_pca": components, "eps_proxy": proxy, "eps_iter": eps - top - components - proxy}


DEFAULTS = {"steps": 20, "bound": 3.0, "clip": 3.0, "top_m": 128, "pca_r": 64, "proxy_dim": 16, "proxy_ratio": 0.1, "proxy_share": 0.5, "proxy_least": 1500, "restarts": 10, "layered": {}, "collapse_above": 0.55, "iteration_collapse_below": 0.01, "budget": {}}

# Names of a controller's parameters in configurations, and the rule's names.
RULE_KEYS = {"warmup": "warmup", "beta": "beta", "gamma": "gamma", "drift_clip": "drift_clip", "eps_min_ratio": "least", "eps_max_ratio": "most", "p": "power", "time_power": "time_power", "adj_clip_low": "gain_low", "adj_clip_high": "gain_high", "recovery_scale": "recovery"}
GUARD_KEYS = {"guard_warmup_static": "warmup", "guard_min_rel_improve": "improve", "guard_min_non_empty_ratio": "non_empty_ratio", "guard_max_cluster_ratio": "max_ratio", "guard_raise_cap_ratio": "cap"}
_RULES_READ = {"feedback": tuple(RULE_KEYS)[:6], "feedback_v2": tuple(k for k in RULE_KEYS if k != "time_power"), "feedback_v3": tuple(RULE_KEYS)}


def control_parameters(budget: Mapping, dataset: str, mode: str) -> dict:
    """boost, boost_above, cap, rule and guard of a run: what budget says for the dataset (budget["datasets"][dataset]), else for all, else the defaults. A mode reads the parameters it has; the guard is there where guarded_feedback is true."""
    own = budget.get("datasets", {}).get(dataset, {})
    found = lambda key, default=None: own.get(key, budget.get(key, default))
    named = lambda keys: {short: found(k) for k, short in keys.items() if found(k) is not None}
    rule = named({k: v for k, v in RULE_KEYS.items() if k in _RULES_READ.get(mode, ())})
    guard = {"warmup": 3} | named(GUARD_KEYS) if mode != "static" and found("guarded_feedback", False) else None
    return {"boost": float(found("collapse_boost", 1.3)), "boost_above": float(found("collapse_threshold", 0.55)), "cap": found("eps_cap"), "rule": rule, "guard": guard, "collapse_below": float(own.get("collapse_min_ratio", 0.01))}


def proxy_budget(eps: float, ratio: float, least: float | None = None) -> tuple[float, float]:
    """The proxy's part of eps and what it leaves: a ratio with an optional floor; nothing left is an error."""
    spent = max(ratio * eps, least if least is not None else 0.0, 0.0)
    if spent >= eps:
        raise ValueError("the proxy's budget must be smaller than the whole")
    return spent, eps - spent


@dataclass
class Plan:
    """What a run is before any row is read: its method, widths, budget and key."""

    dataset: str
    name: str
    k: int
    eps: float
    seed: int
    n: int
    d: int
    cfg: dict
    method: Method
    pca: bool
    init: str
    eps_of: dict[str, float]

    @property
    def key(self) -> tuple[int, str]:
        return self.seed, self.name

    @property
    def m_top(self) -> int:
        return min(self.cfg["top_m"], self.d)

    @property
    def pca_r(self) -> int:
        return min(self.cfg["pca_r"], self.d)

    @property
    def spares(self) -> int:
        return max(128, 8 * self.k)

    @property
    def hash(self) -> str:
        """What tells this run from others, configuration included."""
        return runs.config_hash({"dataset": self.dataset, "method": self.name, "eps": self.eps, "seed": self.seed, "k": self.k, "n": self.n, "d": self.d, **self.cfg})

    def control(self) -> dict:
        return control_parameters(self.cfg["budget"], self.dataset, self.method.budget)

    def lloyd(self, start: np.ndarray, reset: np.ndarray) -> Generator[np.ndarray, stats.Sums, kmeans.Fit]:
        """The run's k-means steps, as kmeans.lloyd() gives them."""
        m, control, steps, eps = self.method, self.control(), self.cfg["steps"], self.eps_of["eps_iter"]
        schedule = {"strong": schedules.strong_contrast, "tail": schedules.fixed_tail}[m.schedule](eps, steps) if m.schedule else None
        rule = control["rule"] | {x: v for x, v in m.feedback.items() if not x.startswith("guard")}
        guard = {**(control["guard"] or {}), **m.feedback.get("guard", {})}
        return kmeans.lloyd(start, steps, eps, self.cfg["clip"], *self.key, mode=m.budget, schedule=schedule, rule=rule, guard=schedules.Guard(**guard) if guard else None, reset=reset, cap=self.cfg.get("eps_cap", control["cap"]), boost=control["boost"], boost_above=control["boost_above"])

    def result(self, fit: kmeans.Fit, meta: Mapping[str, float], quality: Mapping[str, float | None], sse_x: float, loop_ms: float, all_ms: float) -> dict:
        """The result row."""
        cfg, k, shape = self.cfg, self.k, fit.final.shape()
        min_ratio = self.control()["collapse_below"] if cfg["budget"] else cfg["iteration_collapse_below"]
        low = [h["non_empty_k"] < k or h["min_cluster_ratio"] < min_ratio for h in fit.history]
        return {
            "dataset": self.dataset, "method": self.name, "eps_tot": float(self.eps), "seed": self.seed, "k": k, "d": self.d, "r": fit.centroids.shape[1], "T": cfg["steps"], "n": self.n, **self.eps_of, "eps_proxy_ratio": float(cfg["proxy_ratio"]), "clip_norm": float(cfg["clip"]), "algo_variant": self.init,
            "config_hash": self.hash, "runtime_ms_total": loop_ms, "history_path": None, **meta,
            "sse_x": sse_x, "sse_z": fit.final.sse(fit.centroids), **quality, "non_empty_k_final": shape["non_empty"], "max_cluster_ratio_final": shape["max_ratio"], "min_cluster_ratio_final": shape["min_ratio"], "cluster_entropy_final": shape["entropy"],
            "collapse_final": int(shape["non_empty"] < k or shape["max_ratio"] > cfg["collapse_above"]), "collapse_rate": sum(low) / len(low) if low else None, "runtime_ms_all": all_ms, "privacy_audit": "exact moments; raw counts in control",
        }


NO_META = {"score_sensitivity": 0.0, "score_max": 0.0, "pca_noise_scale": 0.0, "proxy_sensitivity": 0.0, "proxy_noise_scale": 0.0, "proxy_dim": 0}


def plan(dataset: str, name: str, k: int, eps: float, seed: int, n: int, d: int, config: Mapping) -> Plan:
    """A run over n rows of d features. A ratio of zero means no proxy at all, and so a public start."""
    cfg, m = merged(DEFAULTS, split_overrides(config)[1]), resolve(name, config)
    width = min(cfg["top_m"], d) if m.features in ("noisy", "random") else d
    pca = m.pca and min(cfg["pca_r"], d) < width
    init = "public_random" if cfg["proxy_ratio"] <= 0 else m.init
    return Plan(dataset, name, k, eps, seed, n, d, cfg, m, pca, init, budget_split(eps, m.features == "noisy", pca, 0.0 if init == "public_random" else cfg["proxy_ratio"]))


def run(df: DataFrame, dataset: str, name: str, k: int, eps: float, seed: int, **config) -> tuple[dict, kmeans.Fit, DataFrame]:
    """One run: the result row, the fit, and the rows with their cluster. Configuration: DEFAULTS, then what the call gives; a method override in it wins over the registry."""
    begun, kept = time.perf_counter(), []

    def hold(frame: DataFrame) -> DataFrame:
        kept.append(frame.persist())
        return kept[-1]

    try:
        bound = merged(DEFAULTS, split_overrides(config)[1])["bound"]
        z = hold(prep.standardise(df, bound))
        p = plan(dataset, name, k, eps, seed, z.count(), len(z.select("features").first()["features"]), config)
        cfg, key, clip, meta = p.cfg, p.key, p.cfg["clip"], dict(NO_META)
        work = z.withColumn("_z", F.col("features"))  # the standardised rows go along for the error in their space
        if p.method.features == "noisy":
            work, _, found = prep.select_noisy(work, p.m_top, p.eps_of["eps_topm"], *key, "select", bound=bound)
            meta |= found
        elif p.method.features == "random":
            work, _ = prep.select_random(work, p.m_top, *key, "select")
        work = prep.row_clip(work, clip)
        if p.pca:
            work, found = reduction.noisy_pca(work, p.pca_r, p.eps_of["eps_pca"], clip, *key)
            meta["pca_noise_scale"] = found["pca_noise_scale"]
        work = hold(prep.row_clip(work, clip))
        q = len(work.select("features").first()["features"])
        if p.init == "public_random":
            start, reset = noise.public_points(k, q, clip, *key, "init"), noise.public_points(p.spares, q, clip, *key, "spare")
        else:
            rows, back, found = noise.proxy(work, cfg["proxy_dim"], p.eps_of["eps_proxy"], clip, *key)
            meta |= {x: found[x] for x in ("proxy_dim", "proxy_sensitivity", "proxy_noise_scale")}
            some = hold(noise.subsample(rows, cfg["proxy_share"], cfg["proxy_least"], *key, "share"))
            start = seeding.initial(p.init, some, back, k, q, clip, *key, restarts=cfg["restarts"], cfg=cfg["layered"])
            reset = noise.lift(seeding.random_rows(some, min(p.spares, 1024), *key, "spare"), back, clip)
        loop = time.perf_counter()
        fit = kmeans.drive([p.lloyd(start, reset)], lambda asked: [stats.cluster_sums(work, c) for _, c in asked])[0]
        loop_ms = (time.perf_counter() - loop) * 1000
        out = hold(stats.assign(work, fit.centroids).select("row_id", F.col("_z").alias("features"), "cluster", "label"))
        found = metrics.quality(out) if df.schema["label"].dataType.typeName() != "void" else {"ari": None, "nmi": None, "f1": None}
        return p.result(fit, meta, found, stats.sums_by(out, "cluster", k).sse_own(), loop_ms, (time.perf_counter() - begun) * 1000), fit, out
    finally:
        for held in kept:
            held.unpersist()


def results_frame(spark, rows: Sequence[dict]) -> DataFrame:
    """Result rows under the fixed schema."""
    fields = [f.split() for f in tables.RESULTS.split(", ")]
    kinds = {"double": float, "int": int, "string": str}
    return spark.createDataFrame([tuple(None if r.get(n) is None else kinds[t](r[n]) for n, t in fields) for r in rows], tables.RESULTS)


def experiment(df: DataFrame, dataset: str, k: int, names: Sequence[str], budgets: Sequence[float], seeds: Sequence[int], **config) -> DataFrame:
    """Results of every method, budget and seed, all in the same passes over the rows (plans/grid.py)."""
    from noisefold.plans import grid

    return results_frame(df.sparkSession, grid.run_all(df, dataset, k, [(m, e, s) for m in names for e in budgets for s in seeds], **config))


def resumed(df: DataFrame, dataset: str, k: int, names: Sequence[str], budgets: Sequence[float], seeds: Sequence[int], folder: str, at_once: int = 64, **config) -> DataFrame:
    """experiment() that goes on where an earlier call ended: results of all the runs asked for, from the table in `folder`, after the missing ones were done.

    Runs go in groups of at_once, each of which shares its passes and commits its rows in one folder, named by the runs and written whole or, without its success mark, not counted; so a killed grid loses at most the group at work, and a repeated attempt writes the same folder. A run is known by its configuration's hash, so other parameters, rows or widths are other runs. Where two drivers commit a run, the row of the first group by name counts.
    """
    from noisefold.plans import grid

    n, d = df.count(), len(df.select("features").first()["features"])
    asked = {plan(dataset, m, k, e, s, n, d, config).hash: (m, e, s) for m in names for e in budgets for s in seeds}
    done = storage.committed(df.sparkSession, folder)
    known = {r["config_hash"] for r in _committed(df.sparkSession, done).select("config_hash").distinct().collect()} if done else set()  # a row a run
    left = [h for h in asked if h not in known]
    for i in range(0, len(left), at_once):
        group = left[i : i + at_once]
        rows = grid.run_all(df, dataset, k, [asked[h] for h in group], **config)
        path = f"{folder.rstrip('/')}/group-{runs.config_hash({'runs': sorted(group)})}"
        results_frame(df.sparkSession, rows).coalesce(1).write.mode("overwrite").parquet(path)
        done.append(path)
    wanted = df.sparkSession.createDataFrame([(h,) for h in asked], "config_hash string")
    found = runs.keep_first(_committed(df.sparkSession, done), ["config_hash"], "_group")
    return found.join(F.broadcast(wanted), "config_hash", "left_semi").select(*(f.split()[0] for f in tables.RESULTS.split(", ")))  # a row a run asked for


def _committed(spark, folders: Sequence[str]) -> DataFrame:
    return spark.read.schema(tables.RESULTS).parquet(*folders).withColumn("_group", F.input_file_name())


def tune(df: DataFrame, dataset: str, name: str, k: int, candidates: Sequence[Mapping], budgets: Sequence[float], seeds: Sequence[int], **config) -> tuple[Mapping, list[dict]]:
    """The best candidate by mean F1, then small deviation, then small error, the first of equals; and each one's summary."""
    import statistics

    from noisefold.plans import grid

    held, out = df.persist(), []
    for c in candidates:
        got = grid.run_all(held, dataset, k, [(name, e, s) for e in budgets for s in seeds], **merged(config, c))
        out.append({"candidate": dict(c), "f1_mean": statistics.fmean(r["f1"] for r in got), "f1_std": statistics.pstdev(r["f1"] for r in got), "sse_mean": statistics.fmean(r["sse_x"] for r in got), "runtime_mean_ms": statistics.fmean(r["runtime_ms_total"] for r in got)})
    held.unpersist()
    best = max(range(len(out)), key=lambda i: (out[i]["f1_mean"], -out[i]["f1_std"], -out[i]["sse_mean"], -i))
    return out[best]["candidate"], out


def tasks(datasets: Sequence[str], names: Sequence[str], budgets: Sequence[float], seeds: Sequence[int]) -> list[dict]:
    import itertools

    return [{"dataset": d, "method": m, "eps": e, "seed": s} for d, m, e, s in itertools.product(datasets, names, budgets, seeds)]


def best_of(results: Mapping[str, Mapping[str, Mapping]], prefix: str) -> dict[str, dict]:
    """Of nested tuning results (dataset, method, then candidate and summary) each dataset's method of highest mean F1 among those whose name begins with prefix, the first of equals: dataset in upper case to method, candidate and summary. Datasets without such a method are left out."""
    out = {}
    for dataset, by_method in results.items():
        own = [(m, p) for m, p in by_method.items() if m.startswith(prefix) and p.get("summary", {}).get("f1_mean") is not None]
        if own:
            name, payload = max(own, key=lambda x: float(x[1]["summary"]["f1_mean"]))
            out[dataset.upper()] = {"method": name, "candidate": dict(payload.get("candidate", {})), "summary": dict(payload["summary"])}
    return out
