"""Operator 6: embedding near-duplicates by spherical-cap filters from random product codes.

A filter is the cap around a direction: the vectors whose inner product with it exceeds alpha. Directions form a product code: the rotated space is cut into blocks, each block has a small random code, and a direction is one codeword per block. A vector is list-decoded to all directions it exceeds alpha with: block by block, partial sums that can't reach alpha any more are dropped. Vectors meet in the filters they share, pairs are verified by their cosine in double precision, and none below the threshold is kept.

alpha and a code's size follow the number of vectors: a filter holds about `bucket` of them, and a pair at the threshold shares about `common` filters of a code. Independent codes are added until, over a bounded sample, pairs at exactly the threshold share a filter in every trial. Nearer pairs share more.

A pair that meets in many filters counts in the first that both have. A filter with more than `most` vectors is split into blocks, and pairs of blocks are groups of their own. A group sends out link counts and a spanning forest, never pairs. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.llm.common import components, cut, forest
from noisefold.llm.topk import usable

THRESHOLD = 0.9


class Codes(list):
    """ProductCodes, and the share of the trial pairs at exactly the threshold that share a filter of theirs."""

    recall: float = 0.0


@dataclass
class ProductCode:
    rotation: np.ndarray  # d x d
    codes: list[np.ndarray]  # a block's codewords, unit vectors
    alpha: float

    @property
    def size(self) -> int:
        return math.prod(len(c) for c in self.codes)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of unit vectors and the filters they exceed alpha with: (row, filter), by row and then filter."""
        m, turned = len(self.codes), unit @ self.rotation
        edges = np.cumsum([0, *(c.shape[1] for c in self.codes)])
        parts = [turned[:, edges[b] : edges[b + 1]] @ self.codes[b].T for b in range(m)]
        rest = np.zeros((m + 1, len(unit)))
        for b in range(m - 1, -1, -1):
            rest[b] = rest[b + 1] + parts[b].max(1)
        need = self.alpha * math.sqrt(m)
        row, total, name = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for b in range(m):
            total = total[:, None] + parts[b][row]
            at, code = np.nonzero(total >= need - rest[b + 1][row][:, None])
            total, row, name = total[at, code], row[at], name[at] * parts[b].shape[1] + code
        return row, name


def decode_all(codes: list[ProductCode], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ProductCode.decode over several codes with filters of their own, by row and then filter."""
    rows, names, base = [], [], 0
    for code in codes:
        row, name = code.decode(unit)
        rows.append(row)
        names.append(name + base)
        base += code.size
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return row[order], name[order]


def fit_codes(sample: np.ndarray, n: int, threshold: float, bucket: int, common: float, trials: int = 2000, most_codes: int = 64, recall: float = 0.995, seed: int = 7) -> "Codes":
    """Codes for n vectors like the sample's unit vectors: as many as it takes until all `trials` pairs at the threshold share a filter. If some don't yet with most_codes, the share that does must reach recall, else it is an error."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    share = min(0.2, max(1e-7, bucket / max(1, n)))
    z = -NormalDist().inv_cdf(share)
    # The share of a cap's vectors whose neighbour at the threshold is in it too.
    edge = z + rng.exponential(1 / max(1.0, z), 50_000)
    both = float(np.mean(threshold * edge + math.sqrt(1 - threshold**2) * rng.standard_normal(50_000) >= z))
    size = max(64, common / max(0.02, both) / share)
    m = min(d, max(2, math.ceil(math.log(size) / math.log(256))))
    per = math.ceil(size ** (1 / m))
    u = sample[rng.integers(0, len(sample), trials)]
    side = rng.standard_normal(u.shape)
    side -= (side * u).sum(1, keepdims=True) * u
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    v = threshold * u + math.sqrt(1 - threshold**2) * np.divide(side, norm, out=np.zeros_like(side), where=norm > 0)
    missed, codes = np.ones(trials, bool), Codes()
    while len(codes) < 2 or (missed.any() and d > 1 and len(codes) < most_codes):
        words = []
        for width in map(len, np.array_split(np.arange(d), m)):
            c = rng.standard_normal((per, width))
            words.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        code = ProductCode(np.linalg.qr(rng.standard_normal((d, d)))[0], words, 0.0)
        got = np.concatenate([np.add.reduce([x[:, i] for x, i in zip(_dots(code, u), rng.integers(0, per, m))]) for _ in range(64)]) / math.sqrt(m)
        code.alpha = min(float(np.quantile(got, 1 - share)), z / math.sqrt(d))
        (ru, fu), (rv, fv) = code.decode(u), code.decode(v)
        missed[np.unique(np.intersect1d(ru * code.size + fu, rv * code.size + fv) // code.size)] = False
        codes.append(code)
    codes.recall = 1.0 if d == 1 else float(1 - missed.mean())
    if codes.recall < recall:
        raise RuntimeError(f"{len(codes)} codes find {codes.recall:.4f} of the pairs at the threshold; {recall} were asked for")
    return codes


def _dots(code: ProductCode, unit: np.ndarray) -> list[np.ndarray]:
    turned, edges = unit @ code.rotation, np.cumsum([0, *(c.shape[1] for c in code.codes)])
    return [turned[:, edges[b] : edges[b + 1]] @ c.T for b, c in enumerate(code.codes)]


def verify(batches: Iterator[pd.DataFrame], codes: list[ProductCode], threshold: float, kind: str) -> Iterator[pd.DataFrame]:
    """Over rows sorted by filter, i, j: link counts (a, null, n) and forest edges (a, b, 0) of each group."""
    rest: pd.DataFrame | None = None
    keys = ["filter", "i", "j"]

    def group(pdf: pd.DataFrame) -> list[tuple]:
        name, cross = int(pdf["filter"].iloc[0]), bool((pdf["i"] != pdf["j"]).iloc[0])
        x = np.frombuffer(b"".join(pdf["vec"]), kind).reshape(len(pdf), -1).astype(float)
        norm = np.sqrt((x * x).sum(1))
        left = np.flatnonzero(pdf["side"].to_numpy() == 0) if cross else np.arange(len(pdf))
        right = np.flatnonzero(pdf["side"].to_numpy() == 1) if cross else left
        near = (x[left] @ x[right].T) / norm[left][:, None] / norm[right][None] >= threshold
        if not cross:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        if not len(a):
            return []
        a, b = left[a], right[b]
        own = _first_shared(codes, x, norm, a, b, name)
        rep, weight = pdf["rep"].to_numpy(), pdf["weight"].to_numpy()
        n = np.bincount(a[own], weight[b[own]], len(rep)) + np.bincount(b[own], weight[a[own]], len(rep))
        label = forest(len(rep), a, b)
        moved = np.flatnonzero(label != np.arange(len(rep)))
        return [(rep[k], None, int(n[k])) for k in np.flatnonzero(n)] + [(rep[k], rep[label[k]], 0) for k in moved]

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[keys].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(1), [True]]))
        rows = [r for s, t in zip(edge[:-1], edge[1:]) if t - s > 1 for r in group(pdf.iloc[s:t])]
        return pd.DataFrame({"a": pd.array([r[0] for r in rows], "Int64"), "b": pd.array([pd.NA if r[1] is None else r[1] for r in rows], "Int64"), "n": [r[2] for r in rows]})

    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        values = pdf[keys].to_numpy()
        k = int(np.flatnonzero((values != values[-1]).any(1)).max(initial=-1)) + 1 if len(pdf) else 0
        rest = pdf.iloc[k:]
        if k:
            yield finished(pdf.iloc[:k])
    if rest is not None and len(rest):
        yield finished(rest)


def _first_shared(codes: list[ProductCode], x: np.ndarray, norm: np.ndarray, a: np.ndarray, b: np.ndarray, name: int) -> np.ndarray:
    """Whether `name` is the first filter that both of each pair have: none before it is shared. The vectors of pairs are decoded again, which is cheaper than to move every vector's filters along."""
    rows = np.unique(np.concatenate([a, b]))
    row, names = decode_all(codes, x[rows] / norm[rows][:, None])
    before = [f[f < name] for f in np.split(names, np.cumsum(np.bincount(row, minlength=len(rows)))[:-1])]
    flat, owner = np.concatenate(before), np.repeat(np.arange(len(rows)), list(map(len, before)))
    names, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    useful = times[column] > 1  # one that a single vector has joins no pair
    spread = np.zeros((len(rows), len(names)), np.float32)
    spread[owner[useful], column[useful]] = 1
    spread = spread[:, times > 1]
    ia, ib = np.searchsorted(rows, a), np.searchsorted(rows, b)
    if not spread.shape[1]:
        return np.ones(len(a), bool)
    if len(a) * 8 < len(rows) ** 2:
        return np.concatenate([(spread[ia[s : s + 4096]] * spread[ib[s : s + 4096]]).sum(1) == 0 for s in range(0, len(a), 4096)])
    return (spread @ spread.T)[ia, ib] == 0


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, bucket: int = 512, common: float = 5.0, most: int = 2048, sample: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    n_links counts the other rows at a cosine of threshold or more; component_id is the smallest vec_id reachable over links; kept is vec_id = component_id. Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components link with nothing, and so does a row without an id (component_id null, kept false). Rows with equal vectors link with each other. Other columns, labels among them, are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    able = rows.where(F.col("vec_id").isNotNull() & usable("v")).where(F.exists("v", lambda x: x != 0))
    lengths = {r["d"]: r["count"] for r in able.groupBy(F.size("v").alias("d")).count().collect()}  # a row for each length
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    d = max(lengths, key=lambda k: (lengths[k], k))
    able = able.where(F.size("v") == d)
    reps = able.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    some = np.array([r["v"] for r in able.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()], float)
    codes = fit_codes(some / np.linalg.norm(some, axis=1, keepdims=True), lengths[d], threshold, bucket, common)
    sent = spark.sparkContext.broadcast(codes)  # grows with the root of the number of filters

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = sent.value
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                x = np.stack(part["v"].to_numpy()).astype(kind)
                unit = x.astype(float)
                row, name = decode_all(codes, unit / np.linalg.norm(unit, axis=1, keepdims=True))
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "weight": part["weight"].to_numpy(), "vec": [v.tobytes() for v in x], "filters": np.split(name, np.cumsum(np.bincount(row, minlength=len(x)))[:-1])})

    held, _ = cut(reps.mapInPandas(decode, "rep long, weight long, vec binary, filters array<long>"), "filters")
    entries = held.select("rep", F.explode("filters").alias("filter"))
    wide = entries.groupBy("filter").count().where(F.col("count") > most).select("filter", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    entries = entries.join(wide, "filter", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    low, high = F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j")
    entries = entries.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("rep", "filter", low, high, (F.col("p") > F.col("o")).cast("int").alias("side"))
    groups = entries.join(held.drop("filters"), "rep").repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    found, _ = cut(groups.mapInPandas(lambda batches: verify(batches, sent.value, threshold, kind), "a long, b long, n long"), "links")
    n = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    known = reps.join(n, "rep", "left").join(comp, "rep", "left").select(F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = able.join(known, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id")
    apart = rows.where(~(F.col("vec_id").isNotNull() & usable("v") & (F.size("v") == d) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
