"""The comparison algorithms: density clustering, merging of small clusters, and genetic search of a schedule."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefold.functions import rng, schedules, vectors
from noisefold.operators import graphs, kmeans, noise, ranks, seeding, stats


def pair_distances(points: DataFrame) -> DataFrame:
    """a, b, distance of all pairs a < b of a bounded sample (the callers take at most a few thousand rows)."""
    a, b = (points.select(F.col("row_id").alias(n), F.col("features").alias(f"_{n}")) for n in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.sqrt(vectors.distance2("_a", "_b")).alias("distance"))


PIVOTS, SAMPLED, BLOCK = 256, 2048, 2048
GROUP_BYTES = 16 << 20  # of the vectors of one side of a group
CELLS = 1 << 18  # numbers in one slab of distances, and rows or links in one batch
SEND = 1000  # sending a row costs about as much as comparing so many pairs


def _sample(points: DataFrame, rows: int) -> np.ndarray:
    return np.array([r["features"] for r in noise.first_by_draw(points, min(SAMPLED, rows), "pivots").select("features").collect()], float)


def _farthest(x: np.ndarray, rows: int) -> np.ndarray:
    picked, near = [0], np.full(len(x), np.inf)
    for _ in range(min(PIVOTS, max(1, math.isqrt(rows)), len(x)) - 1):
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
        if near.max() <= 0:
            break
        picked.append(int(near.argmax()))
    return x[picked]


def pivots(points: DataFrame, rows: int) -> np.ndarray:
    """Up to PIVOTS rows far from each other (about the square root of the rows), of a sample of at most SAMPLED: each is the sampled row that is farthest from those before."""
    return _farthest(_sample(points, rows), rows)


def _visits(x: np.ndarray, c: np.ndarray, radius: float) -> tuple[np.ndarray, ...]:
    """Of some rows: each one's own cell and ring there, and the places (in x), cells and first and last rings of all visits."""
    wide = max(radius, 1e-12)
    far = np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in c], axis=1))
    slack = 1e-9 * (1 + far.max(1))
    own = far.argmin(1)
    nearest = far[np.arange(len(x)), own]
    at, cell = np.nonzero(far <= (nearest + 2 * radius + slack)[:, None])
    low, high = (np.floor((far[at, cell] + s * (radius + slack[at])) / wide).astype(np.int64) for s in (-1, 1))
    return own, np.floor(nearest / wide).astype(np.int64), at, cell, np.maximum(low, 0), high


def _slabs(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """row_id and features of the batches in slabs that have at most CELLS distances to `width` pivots."""
    step = max(1, CELLS // width)
    for pdf in batches:
        for at in range(0, len(pdf), step):
            part = pdf.iloc[at : at + step]
            yield part["row_id"].to_numpy(), np.stack(part["features"].to_numpy()).astype(float)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers from each low to its high, one after another: (place of the pair, number)."""
    n = high - low + 1
    at = np.repeat(np.arange(len(n)), n)
    return at, low[at] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def radius_cells(points: DataFrame, radius: float, centres: np.ndarray) -> DataFrame:
    """cell, ring, home, row_id, vec (packed doubles): where a row is compared. A row is at home in the cell of its nearest pivot, in the ring of its distance there. It visits each cell whose pivot is at most 2 * radius farther than its own, as no row at home elsewhere can be within radius, and there the rings within radius of its distance. A task holds a slab of rows and hands on their places in small batches, however many they are."""
    sent = points.sparkSession.sparkContext.broadcast(centres)  # at most PIVOTS vectors

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _slabs(batches, len(sent.value)):
            own, ring, at, cell, low, high = _visits(x, sent.value, radius)
            visit, rings = _spread(low, high)
            cells, rings, rows = np.concatenate([own, cell[visit]]).astype(np.int32), np.concatenate([ring, rings]), np.concatenate([np.arange(len(x)), at[visit]])
            packed, step = [v.tobytes() for v in x], max(1, (1 << 20) // x.shape[1])
            for k in range(0, len(rows), step):
                part = slice(k, k + step)
                yield pd.DataFrame({"cell": cells[part], "ring": rings[part], "home": np.arange(k, k + len(rows[part])) < len(x), "row_id": ids[rows[part]], "vec": [packed[r] for r in rows[part]]})

    return points.select("row_id", "features").mapInPandas(place, "cell int, ring long, home boolean, row_id long, vec binary")


def _visited(x: np.ndarray, c: np.ndarray, radius: float) -> pd.DataFrame:
    """cell, ring, _h, _v: how many of some rows are at home in and visit the rings that radius_cells would send them to."""
    own, ring, _, cell, low, high = _visits(x, c, radius)
    out = []
    for cells, lows, highs, name in ((own, ring, ring, "_h"), (cell, low, high, "_v")):
        n = pd.DataFrame({"cell": cells, "low": lows, "high": highs}).groupby(["cell", "low", "high"]).size().reset_index(name="n")
        visit, rings = _spread(n["low"].to_numpy(), n["high"].to_numpy())
        out.append(pd.DataFrame({"cell": n["cell"].to_numpy()[visit], "ring": rings, "_h": 0, "_v": 0} | {name: n["n"].to_numpy()[visit]}))
    return pd.concat(out).groupby(["cell", "ring"], as_index=False).sum().astype({"cell": np.int32})


def _cells_pay(x: np.ndarray, c: np.ndarray, radius: float, n: int, block: int) -> bool:
    """Whether rings of metric cells cost less than all pairs of blocks, as estimated from a sample of the n rows: pairs that are compared, and SEND for each row that is made or sent."""
    by, times = _visited(x, c, radius), n / len(x)
    h, v = (by[k].to_numpy(float) * times for k in ("_h", "_v"))
    sent = np.where(h > 0, h * np.ceil(v / block) + v * np.ceil(h / block), 0) + v
    return (h * v + SEND * sent).sum() < n * n / 2 + SEND * n * math.ceil(n / block)


def _radius_groups(points: DataFrame, radius: float) -> DataFrame | None:
    """cell, ring, i, j, side, row_id, vec (packed doubles) and the other columns of points: the groups in which rows are compared, each at most about GROUP_BYTES a side. Rows of side 0 meet those of side 1 in their group, and with side 2 each other. cell is null for blocks, where a pair of rows meets once; else it meets where either is of side 0. None without rows.

    Two plans, by what they cost. In the rings of metric cells (radius_cells), rows at home (side 0) meet visitors (1); rings without rows at home aren't sent to, those of many rows are split. Where everything is within a few radii of everything, so that cells would spare little, rows are dealt to blocks by hash and each two blocks are a group.
    """
    n = points.count()
    if not n:
        return None
    some = _sample(points, n)
    centres = _farthest(some, n)
    block = min(max(BLOCK, n // 16), max(64, GROUP_BYTES // (8 * centres.shape[1])))
    if _cells_pay(some, centres, radius, n, block):
        return _cell_groups(points, radius, centres, block)
    m = -(-n // block)
    own = F.pmod(F.xxhash64("row_id"), F.lit(m)).cast("int")
    rows = points.withColumn("vec", _packed("features")).drop("features").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    rows = rows.withColumns({"cell": F.lit(None).cast("int"), "ring": F.lit(None).cast("long"), "i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "side": side})
    return rows.drop("_own", "_other").repartition(min(m * (m + 1), 2000), "cell", "ring", "i", "j")  # a few for each group, of which adaptive execution would join some


def _cell_groups(points: DataFrame, radius: float, centres: np.ndarray, block: int) -> DataFrame:
    sent = points.sparkSession.sparkContext.broadcast(centres)  # at most PIVOTS vectors

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, x in _slabs(batches, len(sent.value)):
            yield _visited(x, sent.value, radius)

    sizes = points.select("row_id", "features").mapInPandas(count, "cell int, ring long, _h long, _v long")
    sizes = sizes.groupBy("cell", "ring").agg(F.sum("_h").alias("_h"), F.sum("_v").alias("_v")).where("_h > 0")
    rest = [c for c in points.columns if c not in ("row_id", "features")]
    parts = lambda c: F.greatest(F.ceil(F.col(c) / block).cast("int"), F.lit(1))
    part = lambda c: F.pmod(F.xxhash64("row_id"), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    rows = radius_cells(points, radius, centres).join(sizes, ["cell", "ring"])
    homes = rows.where("home").withColumn("i", part("_h")).withColumn("j", every("_v"))
    guests = rows.where("not home").withColumn("j", part("_v")).withColumn("i", every("_h"))
    rows = homes.unionByName(guests).select("cell", "ring", "i", "j", F.when(F.col("home"), 0).otherwise(1).alias("side"), "row_id", "vec")
    return rows.join(points.select("row_id", *rest).distinct(), "row_id") if rest else rows


def _packed(col: str) -> Column:
    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, float).tobytes() for v in x], dtype=object)

    return packed(col)


def _group(batches: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, bool, bool]:
    """Both sides of a group and their vectors, whether they are the same rows, and whether pairs meet once only."""
    rows = pd.concat(batches, ignore_index=True)
    unpacked = lambda df: np.frombuffer(b"".join(df["vec"]), float).reshape(len(df), -1)
    same, once = bool((rows["side"] == 2).any()), bool(rows["cell"].isna().any())
    left, right = (rows, rows) if same else (rows[rows["side"] == 0], rows[rows["side"] == 1])
    if not len(left) or not len(right):
        none = np.zeros((0, 1))
        return left, right, none, none, same, once
    return left, right, unpacked(left), unpacked(right), same, once


def _near(x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i in x and j in y of all pairs within radius, and their distances, some thousands at a time. A matrix product picks the candidates, with room for its rounding; they are measured plainly."""
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    step = max(1, 4 * CELLS // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        both = nx[at : at + step, None] + ny
        apart = part @ y.T
        apart *= -2
        apart += both
        both *= 1e-10
        both += radius * radius * (1 + 1e-10)
        found, measured = np.nonzero(~(apart > both)), max(1, CELLS * 4 // x.shape[1])  # sums that overflow are measured, too
        for k in range(0, len(found[0]), measured):
            i, j = found[0][k : k + measured], found[1][k : k + measured]
            d = np.sqrt(((y[j] - part[i]) ** 2).sum(1))
            ok = d <= radius
            yield at + i[ok], j[ok], d[ok]


def radius_graph(points: DataFrame, radius: float) -> DataFrame:
    """a, b, distance of all pairs a < b within radius, over all rows, exactly.

    Rows meet in the groups of _radius_groups: rings of metric cells, split into blocks however the rows cluster, or, where everything is within a few radii, all pairs of blocks. A group gives its links in small batches, so a task holds the vectors of one group and a slab of distances whatever the number of links.
    """
    groups = _radius_groups(points.select("row_id", "features"), radius)
    if groups is None:
        return points.sparkSession.createDataFrame([], "a long, b long, distance double")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, x, y, same, once = _group(batches)
        ids, guests = left["row_id"].to_numpy(), right["row_id"].to_numpy()
        for i, j, d in _near(x, y, radius):
            a, b = ids[i], guests[j]
            ok = a != b if once and not same else a < b
            yield pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "distance": d[ok]})

    return groups.groupBy("cell", "ring", "i", "j").applyInPandas(compare, "a long, b long, distance double")


def radius_degrees(points: DataFrame, radius: float) -> DataFrame:
    """row_id, n: the links of each row that has any in the radius graph, counted in the groups, which send a number a row."""
    groups = _radius_groups(points.select("row_id", "features"), radius)
    if groups is None:
        return points.sparkSession.createDataFrame([], "row_id long, n long")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, x, y, same, once = _group(batches)
        ids, guests = left["row_id"].to_numpy(), right["row_id"].to_numpy()
        n, m = np.zeros(len(ids), np.int64), np.zeros(len(guests), np.int64)
        for i, j, _ in _near(x, y, radius):
            ok = ids[i] != guests[j] if once and not same else ids[i] < guests[j]
            n += np.bincount(i[ok], minlength=len(n))
            m += np.bincount(j[ok], minlength=len(m))
        yield pd.DataFrame({"row_id": np.concatenate([ids, guests]), "n": np.concatenate([n, m])})

    parts = groups.groupBy("cell", "ring", "i", "j").applyInPandas(count, "row_id long, n long")
    return parts.where("n > 0").groupBy("row_id").agg(F.sum("n").alias("n"))


def radius_forest(points: DataFrame, radius: float, spreads: str | None = None) -> DataFrame:
    """a, b: links that have the same components as the radius graph's, each group's as a forest, so that at most a link for each of its rows leaves it. With a boolean column `spreads`, the forests are of the links between rows that have it; links between one that has it and one that hasn't are given as they are, others left out."""
    groups = _radius_groups(points.select("row_id", "features", *([F.col(spreads).alias("_spreads")] if spreads else [])), radius)
    if groups is None:
        return points.sparkSession.createDataFrame([], "a long, b long")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, x, y, same, once = _group(batches)
        ids, guests = left["row_id"].to_numpy(), right["row_id"].to_numpy()
        able, asked = (v["_spreads"].to_numpy(bool) if spreads else np.ones(len(v), bool) for v in (left, right))
        nodes, at = np.unique(np.concatenate([ids, guests]), return_inverse=True)
        root, at_left, at_right = np.arange(len(nodes)), at[: len(ids)], at[len(ids) :]
        for i, j, _ in _near(x, y, radius):
            beside = able[i] != asked[j] if once and not same else able[i] & ~asked[j]
            if beside.any():
                a, b = ids[i[beside]], guests[j[beside]]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            inner = able[i] & asked[j]
            root = graphs.joined(root, at_left[i[inner]], at_right[j[inner]])
        held = np.flatnonzero(root != np.arange(len(nodes)))
        for k in range(0, len(held), CELLS):
            yield pd.DataFrame({"a": nodes[root[held[k : k + CELLS]]], "b": nodes[held[k : k + CELLS]]})

    return groups.groupBy("cell", "ring", "i", "j").applyInPandas(grow, "a long, b long")


def radius_candidates(pairs: DataFrame, shares: list[float]) -> list[float]:
    """Exact quantiles (linear interpolation) of the pair distances, positive and distinct, ascending."""
    found = pairs.agg(F.percentile("distance", F.array(*map(F.lit, shares))).alias("q")).first()["q"]
    return sorted({max(q, 1e-6) for q in found}) if found else [0.1]


def noisy_degrees(points: DataFrame, links: DataFrame, least: float, eps_seed: float, eps_grow: float, *seed: object) -> DataFrame:
    """radius, row_id, starts, grows: whether a point has `least` neighbours within a radius by a draw at the seeds' budget, and by one at the growing points' budget. links are (radius, a, b), each pair once."""
    ends = links.select("radius", F.explode(F.array("a", "b")).alias("row_id"))
    return noisy_flags(points, ends.groupBy("radius", "row_id").agg(F.count("*").alias("n")), links.select("radius").distinct(), least, eps_seed, eps_grow, *seed)


def noisy_flags(points: DataFrame, degrees: DataFrame, radii: DataFrame, least: float, eps_seed: float, eps_grow: float, *seed: object) -> DataFrame:
    """noisy_degrees from the degrees (radius, row_id, n) of the points that have links, for all points at each of the radii, a row each."""
    every = points.select("row_id").join(radii, how="cross")  # a row for each point and radius, of which there are a few
    noisy = lambda eps, side: F.coalesce("n", F.lit(0)) + rng.laplace_col(1 / max(eps, 1e-8), *seed, side, F.col("radius"), F.col("row_id")) >= least
    return every.join(degrees, ["radius", "row_id"], "left").select("radius", "row_id", noisy(eps_seed, "starts").alias("starts"), noisy(eps_grow, "grows").alias("grows"))


def density_labels(flags: DataFrame, links: DataFrame) -> DataFrame:
    """radius, row_id, cluster: the components of the points that start or grow, as far as one of them starts, numbered by their smallest point; a point beside such a component, which neither starts nor grows, joins the first of them, others get -1.

    A point has one draw of each kind, so the labels don't depend on the order in which points are visited. A scan in order differs from this where a point's first visit uses up its only draw. Everything is joins and aggregates, keyed by radius and point; only the places of the clusters' smallest points are ranked, by exact ranks within a radius.
    """
    able = flags.select("radius", F.col("row_id").alias("p"), "starts", (F.col("starts") | F.col("grows")).alias("spreads"))
    side = lambda c: able.select("radius", F.col("p").alias(c), F.col("spreads").alias(f"{c}_spreads"))
    used = links.join(side("a"), ["radius", "a"]).join(side("b"), ["radius", "b"]).where("a_spreads or b_spreads")
    comp = graphs.components(used.where("a_spreads and b_spreads").select("radius", "a", "b"), ["radius"])
    inner = able.where("spreads").join(comp.withColumnRenamed("node", "p"), ["radius", "p"], "left").select("radius", "p", "starts", F.coalesce("component", "p").alias("component"))
    real = inner.groupBy("radius", "component").agg(F.max("starts").alias("real")).where("real").select("radius", "component")
    inner = inner.join(real, ["radius", "component"]).select("radius", "p", "component")
    beside = used.where("a_spreads <> b_spreads").select("radius", F.when(F.col("a_spreads"), F.col("a")).otherwise(F.col("b")).alias("p"), F.when(F.col("a_spreads"), F.col("b")).otherwise(F.col("a")).alias("edge"))
    edge = beside.join(inner, ["radius", "p"]).groupBy("radius", F.col("edge").alias("p")).agg(F.min("component").alias("component"))
    named = inner.unionByName(edge.select("radius", "p", "component"))
    numbers = ranks.within(real, "radius", "component", "cluster")
    named = named.join(numbers, ["radius", "component"]).select("radius", "p", "cluster")
    return able.select("radius", "p").join(named, ["radius", "p"], "left").select("radius", F.col("p").alias("row_id"), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def density(df: DataFrame, k: int, eps: float, *seed: object, least: int = 10, split: float = 0.5, shares: tuple[float, ...] = (0.01, 0.02, 0.05), most: int | None = 3000, sample: int = 2000) -> tuple[DataFrame, np.ndarray, dict]:
    """Density clustering on at most `most` rows (None: all); the other rows go to the nearest cluster mean. Of the radii the one with most clusters and then least error wins; without any cluster all rows are one. Radii are quantiles of the distances of `sample` rows; the neighbours are the radius graph at the largest of them, cut for the others. Neighbour graph, noisy degrees, components and errors are Spark's joins and aggregates; what reaches the driver is a mean for each cluster."""
    whole = most is None or df.count() <= most
    work = (df if whole else noise.first_by_draw(df, most, *seed, "work")).persist()
    radii = radius_candidates(pair_distances(noise.first_by_draw(work, sample, *seed, "radius")), list(shares))
    near = radius_graph(work, max(radii)).persist()
    links = near.withColumn("radius", F.explode(F.array(*map(F.lit, radii)))).where(F.col("distance") <= F.col("radius")).select("radius", "a", "b")
    flags = noisy_degrees(work, links, least, eps * split, max(eps * (1 - split), 1e-8) / max(2 * k, 1), *seed)
    labels = density_labels(flags, links).persist()
    # The sums of a cluster give its mean and its error; all rows without any cluster count as one.
    long = labels.join(work.select("row_id", "features"), "row_id").withColumn("cluster", F.when(F.max("cluster").over(Window.partitionBy("radius")) < 0, 0).otherwise(F.col("cluster"))).where("cluster >= 0").select("radius", "cluster", F.posexplode("features").alias("dim", "x"))
    sums = long.groupBy("radius", "cluster", "dim").agg(F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("error")).groupBy("radius", "cluster").agg(F.sum("error").alias("error"), F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("means")).collect()
    by = {r: sorted((x for x in sums if x["radius"] == r), key=lambda x: x["cluster"]) for r in {x["radius"] for x in sums}}
    radius = min(by, key=lambda r: (-len(by[r]), sum(x["error"] for x in by[r]), r))
    means = np.array([[m["mean"] for m in x["means"]] for x in by[radius]])
    none = labels.where((F.col("radius") == radius) & (F.col("cluster") >= 0)).isEmpty()
    known = labels.where(F.col("radius") == radius).select("row_id", F.lit(0).alias("_known") if none else F.col("cluster").alias("_known"))
    out = stats.assign(df, means).join(known, "row_id", "left")
    cluster = F.col("_known") if whole else F.when(F.col("_known") >= 0, F.col("_known")).otherwise(F.col("cluster"))
    out = out.withColumn("cluster", cluster.cast("int")).drop("_known")
    used = work.count()
    near.unpersist()
    return out, means, {"radius": radius, "num_clusters": len(means), "used_points": used}


def merge_clusters(counts: np.ndarray, centroids: np.ndarray, k: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Merge non-empty clusters pair by pair, always the pair with the smallest distance over the smaller mass, until k are left: old id -> final id, and the merges."""
    alive = {i: (centroids[i], float(counts[i]), [i]) for i in range(len(counts)) if counts[i] > 0}
    merges, name = [], len(counts)
    while len(alive) > k:
        ids = sorted(alive)
        i, j = min(((a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]), key=lambda p: (np.linalg.norm(alive[p[0]][0] - alive[p[1]][0]) / (min(alive[p[0]][1], alive[p[1]][1]) + 1e-6), p))
        (ci, wi, mi), (cj, wj, mj) = alive.pop(i), alive.pop(j)
        alive[name] = ((ci * wi + cj * wj) / (wi + wj), wi + wj, mi + mj)
        merges.append((i, j))
        name += 1
    return {m: new for new, old in enumerate(sorted(alive)) for m in alive[old][2]}, merges


def merged_kmeans(df: DataFrame, k: int, eps: float, steps: int, clip: float, *seed: object, scale: float = 1.5) -> tuple[DataFrame, np.ndarray, list[tuple[int, int]]]:
    """Noisy k-means with more clusters than asked, merged to k afterwards."""
    base = max(k + 2, math.ceil(scale * k))
    init = seeding.kmeanspp(df, base, *seed)
    fit = kmeans.dp_kmeans(df, init, steps, eps, clip, *seed)
    to, merges = merge_clusters(fit.final.n, fit.centroids, k)
    out = np.zeros((1 + max(to.values(), default=0), init.shape[1]))
    n = np.zeros(len(out))
    for old, new in to.items():
        out[new] += fit.final.s[old]
        n[new] += fit.final.n[old]
    names = F.create_map(*(F.lit(x) for pair in to.items() for x in pair))
    return stats.assign(df, fit.centroids).withColumn("cluster", F.element_at(names, F.col("cluster"))), out / np.maximum(n, 1)[:, None], merges


def _fitness(x: np.ndarray, init: np.ndarray, schedule: np.ndarray, eps: float, clip: float, *seed: object) -> float:
    """Error of noisy k-means under a schedule on an in-memory sample, and a million for each missing cluster."""
    c, left, (k, d) = init.copy(), eps, init.shape
    after = schedules.remaining_after(list(schedule))
    for t, e in enumerate(schedule):
        if left <= 1e-12:
            break
        at = stats._nearest(x, c)
        one = np.eye(k)[at]
        now = min(max(e * (left / after[t] if after[t] > 0 else 0.0), 1e-8), left)
        cnt = max(now * 0.2, 1e-8)
        _, c = noise.noisy_centroids(stats.Sums(one.sum(0), one.T @ x, np.zeros(k)), cnt, max(now - cnt, 1e-8), clip, x, *seed, t)
        left = max(left - now, 0.0)
    at = stats._nearest(x, c)
    return float(((x - c[at]) ** 2).sum()) + 1e6 * (k - len(np.unique(at)))


class Population:
    """Schedules as rows of a matrix, each a split of eps over the steps; all changes are whole-matrix operations with keyed draws."""

    def __init__(self, size: int, steps: int, eps: float, least: float, most: float, *seed: object):
        self.size, self.steps, self.eps, self.bounds, self.seed = size, steps, eps, (least, most), seed
        raw = self.draws("first").exponential(size=(size, steps))
        self.rows = self.within(raw / raw.sum(1, keepdims=True) * eps)

    def draws(self, *what: object) -> np.random.Generator:
        return np.random.default_rng(int(rng.uniform(*self.seed, *what) * 2**52))

    def within(self, raw: np.ndarray) -> np.ndarray:
        return np.array([schedules.project(r, self.eps, *self.bounds) for r in raw])

    def breed(self, generation: int, order: np.ndarray, elite: int, crossover: float, mutation: float) -> None:
        """The elite stays; the rest are children of random pairs of parents, two a pair: with probability crossover each has the one's first steps and the other's last, else they are the parents as they are. A child is moved with probability mutation by a tenth of the mean step, and only then brought within the bounds and the total again: others keep what they inherit, whose sum may differ from it."""
        n, d = self.size - elite, self.draws("breed", generation)
        pairs = -(-n // 2)
        left, right = self.rows[d.integers(0, self.size, pairs)], self.rows[d.integers(0, self.size, pairs)]
        at = np.where(d.random(pairs) <= crossover, d.integers(1, max(2, self.steps), pairs), self.steps)
        first = np.arange(self.steps) < at[:, None]
        children = np.stack([np.where(first, left, right), np.where(first, right, left)], axis=1).reshape(-1, self.steps)[:n]
        moved = d.random(n) <= mutation
        shift = d.standard_normal((n, self.steps)) * self.eps / self.steps * 0.1
        if moved.any():
            children[moved] = self.within(children[moved] + shift[moved])
        self.rows = np.concatenate([self.rows[order[:elite]], children])


def search_schedule(df: DataFrame, k: int, eps: float, steps: int, clip: float, *seed: object, least: float = 0.01, most: float | None = None, population: int = 30, generations: int = 40, crossover: float = 0.8, mutation: float = 0.2, elite: int = 2, rows: int = 3000) -> tuple[list[float], float]:
    """Genetic search of a schedule on at most `rows` rows by keyed draw: (schedule, fitness). A generation's candidates are rows of a frame and are evaluated in parallel on the sample; the best one's fitness is of the whole table, and it is returned within bounds and total."""
    spark = df.sparkSession
    some = noise.first_by_draw(df, rows, *seed, "search").persist()
    init = seeding.kmeanspp(some, k, *seed)
    x = np.array([r["features"] for r in some.select("features").collect()], float)
    sent = spark.sparkContext.broadcast((x, init))  # at most `rows` vectors
    held = Population(population, steps, eps, least, most if most and most > 0 else eps, *seed)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "fitness": [_fitness(*sent.value, np.asarray(s), eps, clip, *seed) for s in pdf["schedule"]]})

    best, known = (math.inf, held.rows[0]), {}
    for g in range(generations):
        new = {r.tobytes(): r for r in held.rows if r.tobytes() not in known}  # the elite's fitness is known
        frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(new.values())], "i int, schedule array<double>").repartition(min(population, spark.sparkContext.defaultParallelism))
        got = {r["i"]: r["fitness"] for r in frame.mapInPandas(evaluate, "i int, fitness double").collect()}
        known = {key: got[i] for i, key in enumerate(new)} | {key: v for key, v in known.items() if key not in new}
        fitness = np.array([known[r.tobytes()] for r in held.rows])
        order = np.argsort(fitness, kind="stable")
        best = min(best, (float(fitness[order[0]]), held.rows[order[0]]), key=lambda b: b[0])
        held.breed(g, order, elite, crossover, mutation)
    some.unpersist()
    fit = kmeans.dp_kmeans(df, init, steps, eps, clip, *seed, schedule=best[1].tolist(), boost=1.0)
    return held.within(best[1][None])[0].tolist(), fit.final.sse(fit.centroids) + 1e6 * (k - fit.final.shape()["non_empty"])
