"""Grids of runs: many methods, budgets and seeds in the same passes over the rows.

A run's space is a small recipe (components taken, clip, projection) that a task applies to the standardised rows as it reads them, so all runs share one frame, and every step of all of them is one job: moments under each run's noise, proxies, rounds of k-means++ over all restarts, k-means steps and final counts. Tasks send sums keyed by (run, cluster); what reaches the driver are models, a few thousand numbers a run. Draws are keyed as in methods.run(), whose rows these are.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noisefold.functions import rng
from noisefold.operators import kmeans, metrics, noise, prep, reduction, seeding, stats
from noisefold.plans import methods


def uniforms(prefix: str, ids: np.ndarray, width: int | None = None) -> np.ndarray:
    """rng.uniform(prefix, id) for each id, or (prefix, id, j) for each j below width."""
    names = [f"{prefix}|{i}" for i in ids.tolist()] if width is None else [f"{prefix}|{i}|{j}" for i in ids.tolist() for j in range(width)]
    u = np.array([int(hashlib.md5(x.encode()).hexdigest()[:13], 16) for x in names], np.float64)
    return ((u + 0.5) / 2**52).reshape(len(ids) if width is None else (len(ids), width))


def laplaces(scale: float, prefix: str, ids: np.ndarray, width: int) -> np.ndarray:
    u = uniforms(prefix, ids, width) - 0.5
    return -scale * np.sign(u) * np.log(1 - 2 * np.abs(u))


@dataclass
class Space:
    """From standardised rows to a run's own: components, clip, projection, clip."""

    clip: float
    picked: np.ndarray | None = None
    mean: np.ndarray | None = None
    components: np.ndarray | None = None

    def __call__(self, z: np.ndarray) -> np.ndarray:
        w = noise.clip_rows(z if self.picked is None else z[:, self.picked], self.clip)
        if self.components is not None:
            w = noise.clip_rows((w - self.mean) @ self.components, self.clip)
        return noise.clip_rows(w, self.clip)


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["features"].to_numpy()).astype(float)


def _lists(values: Iterable) -> pd.Series:
    """A column of lists, which stays one when it is empty."""
    return pd.Series(list(values), dtype=object)


def _added(frame: DataFrame, work: Callable[[Iterator[pd.DataFrame]], dict[tuple, np.ndarray]]) -> dict[tuple, np.ndarray]:
    """Sum arrays by key (a pair of ints) over tasks. work gives a task's own sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = work(batches)
        yield pd.DataFrame({"a": np.array([k[0] for k in own], np.int64), "b": np.array([k[1] for k in own], np.int64), "x": _lists(np.ravel(v) for v in own.values())})

    parts = frame.mapInPandas(run, "a long, b long, x array<double>").select("a", "b", F.posexplode("x").alias("i", "x")).groupBy("a", "b", "i").agg(F.sum("x").alias("x"))
    out: dict[tuple, dict[int, float]] = {}
    for r in parts.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x")).select("a", "b", "x.x").collect():
        out[r["a"], r["b"]] = np.array(r["x"])
    return out


def sums_of(z: DataFrame, spaces: Sequence[Space], asked: Sequence[tuple[int, np.ndarray]]) -> list[stats.Sums]:
    """For each (run, centroids) the sums of the clusters in the run's space: one pass."""
    sent = z.sparkSession.sparkContext.broadcast((list(spaces), list(asked)))  # models

    def work(batches: Iterator[pd.DataFrame]) -> dict[tuple, np.ndarray]:
        spaces, asked = sent.value
        total = {i: np.zeros((len(c), c.shape[1] + 2)) for i, (_, c) in enumerate(asked)}
        for pdf in batches:
            if len(pdf):
                x = _rows(pdf)
                for i, (run, c) in enumerate(asked):
                    total[i] += _cluster_sums(spaces[run](x), c)
        return {(i, j): v[j] for i, v in total.items() for j in np.flatnonzero(v[:, 0])}

    got = _added(z.select("features"), work)
    sent.unpersist()
    return [_as_sums(got, i, c.shape) for i, (_, c) in enumerate(asked)]


def _cluster_sums(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    one = np.zeros((len(x), len(c)))
    one[np.arange(len(x)), stats._nearest(x, c)] = 1
    return one.T @ np.column_stack([np.ones(len(x)), (x * x).sum(1), x])


def _as_sums(got: dict[tuple, np.ndarray], i: int, shape: tuple[int, int]) -> stats.Sums:
    out = np.zeros((shape[0], shape[1] + 2))
    for j in range(shape[0]):
        if (i, j) in got:
            out[j] = got[i, j]
    return stats.Sums(out[:, 0], out[:, 2:], out[:, 1])


def _spaces(z: DataFrame, plans: Sequence[methods.Plan], metas: Sequence[dict]) -> list[Space]:
    """Selections from one aggregate of scores, noisy components from one pass of moments."""
    out = [Space(p.cfg["clip"]) for p in plans]
    scores = None
    for p, space, meta in zip(plans, out, metas):
        if p.method.features == "noisy":
            if scores is None:
                scores = np.array([r["score"] for r in prep.feature_scores(z, p.cfg["bound"]).orderBy("dim").collect()])
            picked, found = prep.noisy_choice(scores, p.n, p.m_top, p.eps_of["eps_topm"], *p.key, "select", bound=p.cfg["bound"])
            meta |= found
            space.picked = np.array(picked) if p.m_top < len(scores) else None
        elif p.method.features == "random":
            space.picked = np.array(sorted(rng.choose(p.d, p.m_top, *p.key, "select")))
    reduced = [i for i, p in enumerate(plans) if p.pca]
    if not reduced:
        return out
    width = [p.d if s.picked is None else len(s.picked) for p, s in zip(plans, out)]
    scales = {i: reduction.pca_scale(plans[i].eps_of["eps_pca"], plans[i].cfg["clip"], width[i]) for i in reduced}
    prefixes = {i: rng.key(*plans[i].key, "pca") for i in reduced}

    def work(batches: Iterator[pd.DataFrame]) -> dict[tuple, np.ndarray]:
        total = {(i, 0): np.zeros((width[i] + 1, width[i] + 1)) for i in reduced}
        for pdf in batches:
            if len(pdf):
                rows, ids = _rows(pdf), pdf["row_id"].to_numpy()
                for i in reduced:
                    x = np.column_stack([np.ones(len(ids)), out[i](rows) + laplaces(scales[i], prefixes[i], ids, width[i])])
                    total[i, 0] += x.T @ x
        return total

    for (i, _), g in _added(z.select("row_id", "features"), work).items():
        g = g.reshape(width[i] + 1, width[i] + 1)
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        out[i].mean, out[i].components = mean, reduction.components(g[1:, 1:] / n - np.outer(mean, mean), plans[i].pca_r)
        metas[i]["pca_noise_scale"] = scales[i]
    return out


def _proxies(z: DataFrame, spaces: Sequence[Space], prefixes: dict[int, str], projections: dict[int, np.ndarray], scales: dict[int, float], sizes: dict[int, int], n: int) -> DataFrame:
    """run, row_id, features: each run's noisy projection of its subsample of sizes[run] rows."""
    which = noise.cuts_by_draw(z, {i: (f"{prefixes[i]}|share", sizes[i]) for i in prefixes if sizes[i] < n})
    sent = z.sparkSession.sparkContext.broadcast((list(spaces), projections))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces, projections = sent.value
        for pdf in batches:
            if not len(pdf):
                continue
            rows, ids = _rows(pdf), pdf["row_id"].to_numpy()
            for i, r in projections.items():
                mine = np.ones(len(ids), bool)
                if i in which:
                    u = uniforms(f"{prefixes[i]}|share", ids)
                    mine = (u < which[i][0]) | (u == which[i][0]) & (ids <= which[i][1])
                if mine.any():
                    x = spaces[i](rows[mine]) @ r + laplaces(scales[i], f"{prefixes[i]}|proxy", ids[mine], r.shape[1])
                    yield pd.DataFrame({"run": np.int32(i), "row_id": ids[mine], "features": list(x)})

    return z.select("row_id", "features").mapInPandas(work, "run int, row_id long, features array<double>")


def kmeanspp_chains(rows: DataFrame, chains: Sequence[tuple[int, str]], k: int) -> list[np.ndarray]:
    """seeding.kmeanspp() for many (run, key) at once: each of the k rounds is one pass over rows (run, row_id, features)."""
    by_run: dict[int, list[int]] = {}
    for c, (run, _) in enumerate(chains):
        by_run.setdefault(run, []).append(c)
    picks: list[list[list[float]]] = [[] for _ in chains]
    for t in range(k):
        sent = rows.sparkSession.sparkContext.broadcast([np.array(p, float) for p in picks])

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[float, int, list[float]]] = {}
            for pdf in batches:
                for run, own in pdf.groupby("run"):
                    if run not in by_run:
                        continue
                    x, ids = _rows(own), own["row_id"].to_numpy()
                    for c in by_run[run]:
                        u = uniforms(f"{chains[c][1]}|pp|{t}", ids)  # noqa: B023
                        near = np.full(len(ids), np.inf)
                        for p in sent.value[c]:  # noqa: B023
                            np.minimum(near, ((x - p) ** 2).sum(1), out=near)
                        with np.errstate(divide="ignore"):
                            w = -u if t == 0 else np.where(near > 0, np.log(u) / near, -np.inf)  # noqa: B023
                        at = np.lexsort((ids, -w))[0]
                        if c not in best or (w[at], -ids[at]) > (best[c][0], -best[c][1]):
                            best[c] = float(w[at]), int(ids[at]), x[at].tolist()
            yield pd.DataFrame({"chain": np.array(list(best), np.int32), "w": [b[0] for b in best.values()], "row_id": np.array([b[1] for b in best.values()], np.int64), "features": _lists(b[2] for b in best.values())})

        found = rows.mapInPandas(work, "chain int, w double, row_id long, features array<double>").groupBy("chain").agg(F.max_by("features", F.struct("w", -F.col("row_id"))).alias("c"))
        for r in found.collect():
            picks[r["chain"]].append(r["c"])
        sent.unpersist()
    return [np.array(p, float) for p in picks]


def _chain_sums(rows: DataFrame, asked: Sequence[tuple[int, np.ndarray]]) -> list[stats.Sums]:
    """Sums of clusters of the proxies, for each (run, centroids)."""
    by_run: dict[int, list[int]] = {}
    for c, (run, _) in enumerate(asked):
        by_run.setdefault(run, []).append(c)
    sent = rows.sparkSession.sparkContext.broadcast(list(asked))

    def work(batches: Iterator[pd.DataFrame]) -> dict[tuple, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for run, own in pdf.groupby("run"):
                for c in by_run.get(run, ()):
                    total[c] = total.get(c, 0) + _cluster_sums(_rows(own), sent.value[c][1])
        return {(c, j): v[j] for c, v in total.items() for j in np.flatnonzero(v[:, 0])}

    got = _added(rows, work)
    sent.unpersist()
    return [_as_sums(got, c, m.shape) for c, (_, m) in enumerate(asked)]


def _fuzzy(rows: DataFrame, prefixes: dict[int, str], k: int, most: int = 3000) -> dict[int, np.ndarray]:
    """seeding.fuzzy() of runs: k-means++ over each run's sample in common passes, then a task a run, as the sample is at most `most` rows by its definition."""
    prefix = F.element_at(F.array(*(F.lit(prefixes.get(i, "")) for i in range(max(prefixes) + 1))), F.col("run") + 1)
    order = Window.partitionBy("run").orderBy("_u", "row_id")
    some = rows.where(F.col("run").isin(list(prefixes))).withColumn("_u", rng.uniform_col(prefix, "fuzzy", F.col("row_id"))).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("run", "row_id", "features", "_r").persist()
    starts = dict(zip(prefixes, kmeanspp_chains(some.drop("_r"), [(i, f"{prefixes[i]}|fuzzy") for i in prefixes], k)))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        run = int(group["run"].iloc[0])
        return pd.DataFrame({"run": np.int32(run), "c": [seeding.fuzzy_rounds(_rows(group.sort_values("_r")), starts[run]).ravel()]})

    out = {r["run"]: np.array(r["c"]).reshape(k, -1) for r in some.groupBy("run").applyInPandas(settle, "run int, c array<double>").collect()}
    some.unpersist()
    return out


def _starts(rows: DataFrame, plans: Sequence[methods.Plan], prefixes: dict[int, str]) -> dict[int, np.ndarray]:
    """Centroids in the proxies' spaces, by each run's kind of seeding."""
    chains: list[tuple[int, str]] = []
    for i, prefix in prefixes.items():
        p = plans[i]
        tries = {"kpp": None, "kpp_rr": p.cfg["restarts"], "layered": p.cfg["layered"].get("rr_restarts_light", p.cfg["restarts"])}[p.init]
        chains += [(i, prefix)] if tries is None else [(i, f"{prefix}|restart|{r}") for r in range(max(int(tries), 1))]
    k = plans[0].k
    found = kmeanspp_chains(rows, chains, k)
    sums = _chain_sums(rows, [(run, c) for (run, _), c in zip(chains, found)])
    out: dict[int, np.ndarray] = {}
    shape: dict[int, dict[str, float]] = {}
    for (run, _), c, s in zip(chains, found, sums):
        if run not in out or s.sse(c) < shape[run]["sse"]:  # the first of equals
            out[run], shape[run] = c, {"sse": s.sse(c)} | s.shape()
    weak = {i: prefixes[i] for i in out if plans[i].init == "layered" and seeding.wants_fuzzy(shape[i], k, plans[i].cfg["layered"])}
    if weak:
        heavy = _fuzzy(rows, weak, k)
        for i, s in zip(heavy, _chain_sums(rows, list(heavy.items()))):
            cfg = plans[i].cfg["layered"]
            if seeding.layered_score({"sse": s.sse(heavy[i])} | s.shape(), k, cfg) + cfg.get("switch_margin", 0.0) < seeding.layered_score(shape[i], k, cfg):
                out[i] = heavy[i]
    return out


def _spares(rows: DataFrame, plans: Sequence[methods.Plan], prefixes: dict[int, str]) -> dict[int, np.ndarray]:
    """Random rows of each run's proxies, at most 1,024."""
    prefix = F.element_at(F.array(*(F.lit(prefixes.get(i, "")) for i in range(max(prefixes) + 1))), F.col("run") + 1)
    order = Window.partitionBy("run").orderBy("_u", "row_id")
    most = min(plans[0].spares, 1024)
    got = rows.withColumn("_u", rng.uniform_col(prefix, "spare", "rows", F.col("row_id"))).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("run", "row_id", "features").collect()
    out: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r["run"], r["row_id"])):
        out.setdefault(r["run"], []).append(r["features"])
    return {i: np.array(v, float) for i, v in out.items()}


def _finals(z: DataFrame, spaces: Sequence[Space], fits: Sequence[kmeans.Fit], k: int, d: int) -> tuple[list[float], list[list[tuple[int, int, int]]]]:
    """Of each run the error against its clusters' own means in the standardised space, and its contingency table."""
    sent = z.sparkSession.sparkContext.broadcast((list(spaces), [f.centroids for f in fits]))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces, centroids = sent.value
        sums, counts = {}, {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, label = _rows(pdf), pdf["label"]
            known = label.notna().to_numpy()
            for i, (space, c) in enumerate(zip(spaces, centroids)):
                at = stats._nearest(space(x), c)
                one = np.zeros((len(x), k))
                one[np.arange(len(x)), at] = 1
                sums[i] = sums.get(i, 0) + one.T @ np.column_stack([np.ones(len(x)), (x * x).sum(1), x])
                for pair, n in zip(*np.unique(np.column_stack([label[known].to_numpy().astype(np.int64), at[known]]), axis=0, return_counts=True)):
                    key = i, int(pair[1]), int(pair[0])
                    counts[key] = counts.get(key, 0) + int(n)
        full = [(i, int(j), s[j]) for i, s in sums.items() for j in np.flatnonzero(s[:, 0])]
        yield pd.DataFrame({"run": np.array([f[0] for f in full], np.int32), "cluster": np.array([f[1] for f in full], np.int32), "label": pd.array([None] * len(full), "Int64"), "sums": _lists(f[2] for f in full)})
        yield pd.DataFrame({"run": np.array([c[0] for c in counts], np.int32), "cluster": np.array([c[1] for c in counts], np.int32), "label": pd.array([c[2] for c in counts], "Int64"), "sums": _lists([float(n)] for n in counts.values())})

    parts = z.select("features", "label").mapInPandas(work, "run int, cluster int, label long, sums array<double>").select("run", "cluster", "label", F.posexplode("sums").alias("i", "x")).groupBy("run", "cluster", "label", "i").agg(F.sum("x").alias("x"))
    total, tables = np.zeros((len(fits), k, d + 2)), [[] for _ in fits]
    for r in parts.collect():  # models and tables of classes against clusters
        if r["label"] is None:
            total[r["run"], r["cluster"], r["i"]] = r["x"]
        else:
            tables[r["run"]].append((r["label"], r["cluster"], int(r["x"])))
    sent.unpersist()
    return [stats.Sums(t[:, 0], t[:, 2:], t[:, 1]).sse_own() for t in total], tables


def run_all(df: DataFrame, dataset: str, k: int, runs: Sequence[tuple[str, float, int]], **config) -> list[dict]:
    """Result rows of all (method, budget, seed), in their order, as methods.run() gives each; a run's time is its share of the whole."""
    begun, held = time.perf_counter(), []
    if not runs:
        return []
    try:
        z = prep.standardise(df, methods.merged(methods.DEFAULTS, methods.split_overrides(config)[1])["bound"])
        if z.rdd.getNumPartitions() < (cores := z.sparkSession.sparkContext.defaultParallelism):  # a small table, and much to do with each row
            z = z.repartition(cores)
        z.persist()
        held.append(z)
        n, d = z.count(), len(z.select("features").first()["features"])
        plans = [methods.plan(dataset, name, k, eps, seed, n, d, config) for name, eps, seed in runs]
        metas: list[dict] = [dict(methods.NO_META) for _ in plans]
        spaces = _spaces(z, plans, metas)
        width = [s.components.shape[1] if s.components is not None else p.d if s.picked is None else len(s.picked) for p, s in zip(plans, spaces)]
        prefixes = {i: rng.key(*p.key) for i, p in enumerate(plans) if p.init != "public_random"}
        start, spare = {}, {}
        if prefixes:
            projections, scales, sizes = {}, {}, {}
            for i in prefixes:
                p = plans[i]
                projections[i] = noise.projection(width[i], p.cfg["proxy_dim"], *p.key)
                found = noise.proxy_facts(projections[i], p.eps_of["eps_proxy"], p.cfg["clip"])
                metas[i] |= {x: found[x] for x in ("proxy_dim", "proxy_sensitivity", "proxy_noise_scale")}
                scales[i] = found["proxy_noise_scale"]
                sizes[i] = max(int(n * p.cfg["proxy_share"]), p.cfg["proxy_least"]) if 0 < p.cfg["proxy_share"] < 1 else n
            rows = _proxies(z, spaces, prefixes, projections, scales, sizes, n).persist()
            held.append(rows)
            begins, spares = _starts(rows, plans, prefixes), _spares(rows, plans, prefixes)
            for i in prefixes:
                back, clip = np.linalg.pinv(projections[i]), plans[i].cfg["clip"]
                start[i], spare[i] = noise.lift(begins[i], back, clip), noise.lift(spares[i], back, clip)
        for i, p in enumerate(plans):
            if i not in start:
                start[i], spare[i] = noise.public_points(k, width[i], p.cfg["clip"], *p.key, "init"), noise.public_points(p.spares, width[i], p.cfg["clip"], *p.key, "spare")
        loop = time.perf_counter()
        fits = kmeans.drive([p.lloyd(start[i], spare[i]) for i, p in enumerate(plans)], lambda asked: sums_of(z, spaces, asked))
        loop_ms = (time.perf_counter() - loop) * 1000 / len(plans)
        errors, tables = _finals(z, spaces, fits, k, d)
        all_ms = (time.perf_counter() - begun) * 1000 / len(plans)
        named = df.schema["label"].dataType.typeName() != "void"
        out = []
        for p, fit, meta, error, table in zip(plans, fits, metas, errors, tables):
            ari, nmi = metrics.agreement_of(table) if named else (None, None)
            out.append(p.result(fit, meta, {"ari": ari, "nmi": nmi, "f1": metrics.macro_f1(table)[0] if named else None}, error, loop_ms, all_ms))
        return out
    finally:
        for frame in held:
            frame.unpersist()
