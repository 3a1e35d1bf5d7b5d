"""Clustering quality from the contingency table of classes and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """label, cluster, n: rows of each pair that occurs."""
    return df.where(F.col(label).isNotNull() & F.col(cluster).isNotNull()).groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """ari (chance-adjusted pair counting) and nmi (arithmetic mean of the entropies): one row."""
    pairs = lambda n: n * (n - 1) / 2
    rows, cols = (table.groupBy(c).agg(F.sum("n").alias("n")) for c in ("label", "cluster"))
    total = table.agg(F.sum("n").cast("double").alias("t"), F.sum(pairs(F.col("n"))).alias("both"))
    side = lambda df, name: df.crossJoin(F.broadcast(total.select("t"))).agg(F.sum(pairs(F.col("n"))).alias(f"{name}_pairs"), F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias(f"{name}_h"))
    joint = table.join(rows.withColumnRenamed("n", "a"), "label").join(cols.withColumnRenamed("n", "b"), "cluster").crossJoin(F.broadcast(total.select("t")))
    mutual = joint.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    one = side(rows, "l").crossJoin(side(cols, "c")).crossJoin(total).crossJoin(mutual)  # rows of one
    expected = F.col("l_pairs") * F.col("c_pairs") / pairs(F.col("t"))
    top = (F.col("l_pairs") + F.col("c_pairs")) / 2
    ari = F.when((top == expected) | (F.col("t") < 2), 1.0).otherwise((F.col("both") - expected) / (top - expected))
    h = (F.col("l_h") + F.col("c_h")) / 2
    return one.select(ari.alias("ari"), F.when(h <= 0, 1.0).otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / h).alias("nmi"))


def agreement_of(rows: list[tuple[int, int, int]]) -> tuple[float, float]:
    """ari and nmi of collected (label, cluster, n) rows, as agreement() has them."""
    pairs = lambda x: float((x * (x - 1) / 2).sum())
    if not rows:
        return 1.0, 1.0
    labels, clusters = (np.unique([r[i] for r in rows], return_inverse=True)[1] for i in (0, 1))
    n = np.array([r[2] for r in rows], float)
    a, b, t = np.bincount(labels, n), np.bincount(clusters, n), n.sum()
    both, expected, top = pairs(n), pairs(a) * pairs(b) / (t * (t - 1) / 2) if t > 1 else 0.0, (pairs(a) + pairs(b)) / 2
    h = -sum(float((x / t * np.log(x / t)).sum()) for x in (a, b)) / 2
    mutual = float((n / t * np.log(n * t / (a[labels] * b[clusters]))).sum())
    return 1.0 if t < 2 or top == expected else (both - expected) / (top - expected), 1.0 if h <= 0 else max(mutual, 0.0) / h


def match(table: np.ndarray) -> list[int]:
    """For each row of a square table of counts the column of a best assignment (largest sum); of several best the lexicographically smallest.

    Shortest augmenting paths give one best assignment and prices u, v with u + v at most the cost of every pair; the best assignments are those made of pairs where they are equal. So each row in turn takes the smallest such column that it can get by shifting later rows among such columns, along one alternating path.
    """
    cost = -np.asarray(table).astype(np.int64)
    n = len(cost)
    u, v, owner = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    huge = np.iinfo(np.int64).max // 4
    for row in range(n):
        least, way, used, i, j = np.full(n, huge), np.full(n, -1), np.zeros(n, bool), row, -1
        while True:
            reach = cost[i] - u[i] - v
            closer = ~used & (reach < least)
            least[closer], way[closer] = reach[closer], j
            j = int(np.where(used, huge, least).argmin())
            step = least[j]
            u[row] += step
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            used[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
        while j >= 0:
            before = way[j]
            owner[j] = owner[before] if before >= 0 else row
            j = before
    out = np.empty(n, int)
    out[owner] = np.arange(n)
    tight = cost - u[:, None] - v == 0
    free = np.ones(n, bool)  # columns of this row and later ones
    for row in range(n):
        for j in np.flatnonzero(tight[row] & free):
            if j >= out[row]:
                break
            if (path := _shift(tight, owner, free, int(owner[j]), int(j), int(out[row]))) is not None:
                owner[j] = row
                for r, c in path:
                    owner[c] = r
                out[owner] = np.arange(n)
                break
        free[out[row]] = False
    return out.tolist()


def _shift(tight: np.ndarray, owner: np.ndarray, free: np.ndarray, row: int, taken: int, goal: int) -> list[tuple[int, int]] | None:
    """New (row, column) pairs by which `row` and rows after it get other free columns than `taken`, the last one `goal`; None if they can't. Breadth first over columns."""
    came: dict[int, tuple[int, int]] = {}
    open_ = free.copy()
    open_[taken] = False
    rows = [(row, -1)]
    while rows and goal not in came:
        nxt = []
        for r, c in rows:
            for j in np.flatnonzero(tight[r] & open_).tolist():
                open_[j] = False
                came[j] = (r, c)
                nxt.append((int(owner[j]), j))
        rows = nxt
    if goal not in came:
        return None
    path, c = [], goal
    while c >= 0:
        r, before = came[c]
        path.append((r, c))
        c = before
    return path


def macro_f1(rows: list[tuple[int, int, int]]) -> tuple[float, dict[int, int]]:
    """Macro F1 of (label, cluster, n) rows after aligning clusters to classes one to one, and the alignment.

    Classes and clusters are taken by rank, so ids may be any integers (-1 for noise is one like others). The assignment with most common rows counts, of several the one whose first cluster has the lowest class, then the second, and so on. A cluster that gets a class has its name even without a common row; one that gets none, where there are more clusters than classes, keeps its own id. The mean is over the union of labels and names; 0/0 counts as 0.
    """
    if not rows:
        return 0.0, {}
    classes, clusters = (sorted({r[i] for r in rows}) for i in (0, 1))
    size = max(len(classes), len(clusters))
    table = np.zeros((size, size))
    at_class, at_cluster = ({x: i for i, x in enumerate(ids)} for ids in (classes, clusters))
    for a, b, n in rows:
        table[at_cluster[b], at_class[a]] += n
    k = match(table)
    mapping = {b: classes[k[i]] if k[i] < len(classes) else b for i, b in enumerate(clusters)}
    names = {a for a, _, _ in rows} | set(mapping.values())
    hit, true, said = ({c: 0.0 for c in names} for _ in range(3))
    for a, b, n in rows:
        true[a] += n
        said[mapping[b]] += n
        if mapping[b] == a:
            hit[a] += n
    return float(np.mean([2 * hit[c] / (true[c] + said[c]) if true[c] + said[c] else 0.0 for c in sorted(names)])), mapping


def quality(df: DataFrame, label: str = "label", cluster: str = "cluster") -> dict[str, float]:
    """ari, nmi and f1 of a labelled and clustered frame."""
    table = contingency(df, label, cluster)
    one = agreement(table).first()
    return {"ari": one["ari"], "nmi": one["nmi"], "f1": macro_f1([tuple(r) for r in table.collect()])[0]}
