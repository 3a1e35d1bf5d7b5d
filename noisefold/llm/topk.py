"""Operator 3: exact top-k by inner product with pivot-table elimination.

Every vector's distances to a table of pivots are computed once and written down with it. For a query q and a candidate x, |d(q, p) - d(x, p)| bounds their distance from below for each pivot p, and the largest of these bounds over all pivots bounds the inner product from above, since q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. Candidates lie in order of their nearest pivot and the distance to it; a bucket of them has an interval of distances for each pivot and so one bound. Buckets are evaluated in the order of their bounds until none that is left reaches the k-th best score, which makes the answer exact. Queries of one nearest pivot go together, so that a bucket is one matrix product.

Queries and candidates meet in blocks: a pair of a query block and a candidate block is a task's group, so memory is bounded and no vector list is collected. A block holds the vectors of whole cells (a cell: those of one nearest pivot) or a part of one large cell. A query goes only to blocks with a cell whose bound reaches the query's first threshold, its k-th best score in a bounded sample (`sample` vectors by hash of the id), from which the pivots come too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefold.llm.common import cut

_FOUND = "query_id long, vec_id long, score long"
_NONE = np.iinfo(np.int64).min
_BUCKET = 64
_TOGETHER = 64


def usable(vector: str) -> Column:
    """True for a vector that is not null or empty and has finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal from the vector farthest from the mean."""
    if not len(sample):
        return sample
    x = sample.astype(float)
    near = ((x - x.mean(0)) ** 2).sum(1)
    picked: list[int] = []
    for _ in range(min(n, len(x))):
        k = int(near.argmax())
        d = ((x - x[k]) ** 2).sum(1)
        near = d if not picked else np.minimum(near, d)
        picked.append(k)
    return sample[picked]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where these are exact, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, p = x.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (a @ p.T), 0.0))


def _first_thresholds(query_ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score in the sample without itself; the least long where there are fewer."""
    out = np.full(len(q), _NONE)
    for at, (own, scores) in enumerate(zip(query_ids, _products(q, sample))):
        others = scores[sample_ids != own]
        if len(others) >= k:
            out[at] = np.partition(others, len(others) - k)[len(others) - k]
    return out


def _bounds(dq: np.ndarray, nq: np.ndarray, low: np.ndarray, high: np.ndarray, nx: np.ndarray, reach: float) -> np.ndarray:
    """(query, set) most that the inner product can be with vectors whose pivot distances lie in low..high and whose squared norms are at most nx; reach is the pivots' largest norm."""
    apart = np.zeros((len(dq), len(low)))
    for p in range(dq.shape[1]):
        np.maximum(apart, np.maximum(dq[:, p, None] - high[None, :, p], low[None, :, p] - dq[:, p, None]), out=apart)
    norms = nq[:, None] + nx[None]
    apart = np.maximum(apart - 1e-6 * (np.sqrt(norms) + reach) - 1e-6, 0)  # distances are kept as single floats
    return (norms - apart * apart) / 2 + 1e-9 * norms + 1


def _squares(x: np.ndarray) -> np.ndarray:
    return (x.astype(float) ** 2).sum(1)


def _reach(pivots: np.ndarray) -> float:
    return float(np.sqrt(_squares(pivots).max(initial=0)))


def search(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int, stats: list[int] | None = None, dq: np.ndarray | None = None, dx: np.ndarray | None = None, least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in this block that may be among its k best of all. dq, dx and least are the pivot distances and first thresholds where they are known; stats takes the number of candidates evaluated for each query, in the queries' order."""
    dq = _pivot_distances(q, pivots) if dq is None else dq
    dx = _pivot_distances(x, pivots) if dx is None else dx
    least = _first_thresholds(query_ids, q, sample_ids, sample, k) if least is None else least
    line = np.lexsort((ids, dx.min(1), dx.argmin(1)))
    ids, x, dx = ids[line], x[line], dx[line]
    starts = np.arange(0, len(x), _BUCKET)
    low, high = np.minimum.reduceat(dx, starts, axis=0), np.maximum.reduceat(dx, starts, axis=0)
    nx, nq, reach = np.maximum.reduceat(_squares(x), starts), _squares(q), _reach(pivots)
    home, evaluated = dq.argmin(1), np.zeros(len(q), np.int64)
    out = []
    for cell in np.unique(home):
        of_cell = np.flatnonzero(home == cell)
        for some in np.split(of_cell, range(_TOGETHER, len(of_cell), _TOGETHER)):
            bound, top, own = _bounds(dq[some], nq[some], low, high, nx, reach), least[some].copy(), query_ids[some]
            left, step = np.argsort(-bound.max(0), kind="stable"), max(1, 4 * k // _BUCKET)
            row, found, best = (np.empty(0, np.int64) for _ in range(3))
            while len(left := left[(bound[:, left] >= top[:, None]).any(0)]):
                part, left, step = left[:step], left[step:], min(2 * step, 64)
                at = (part[:, None] * _BUCKET + np.arange(_BUCKET)).ravel()
                at = at[at < len(x)]
                score = _products(q[some], x[at])
                evaluated[some] += len(at)
                r, c = np.nonzero((score >= top[:, None]) & (ids[at][None] != own[:, None]))
                row, found, best = np.append(row, r), np.append(found, ids[at][c]), np.append(best, score[r, c])
                order = np.lexsort((found, -best, row))
                row, found, best = row[order], found[order], best[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top[row[rank == k - 1]] = best[rank == k - 1]
                row, found, best = (v[rank < k] for v in (row, found, best))
            out += list(zip(own[row].tolist(), found.tolist(), best.tolist()))
    if stats is not None:
        stats += evaluated.tolist()
    return out


def _lay_out(counts: list[int], most: int) -> tuple[list[int], list[int], int]:
    """Cells into blocks of about `most`: each cell's first block, the number of its blocks, and the number of all. Small cells share a block, a large one has blocks of its own."""
    first, parts, n, held = [], [], 0, 0
    for c in counts:
        if held and held + c > most:
            n, held = n + 1, 0
        first.append(n)
        parts.append(max(1, math.ceil(c / most)))
        held += c
        if held >= most:
            n, held = n + parts[-1], 0
    return first, parts, n + (held > 0)


def _dealt(cell: str, key: str, first: list[int], parts: list[int]) -> Column:
    """The block of a row: a part of its cell by hash."""
    table = lambda v: F.element_at(F.array(*map(F.lit, v)), F.col(cell) + 1)
    return (table(first) + F.pmod(F.xxhash64(key), table(parts))).cast("int")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, pivots: int = 48, sample: int = 2048, block_rows: int = 8192, block_queries: int = 4096, with_evaluated: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of floor(scale * x) for each query, ties to the smaller vec_id. with_evaluated adds evaluated, the number of candidates whose product was computed for the query.

    Rows with a null id, and vectors that are null, empty, of another length than most, or hold null or non-finite components take no part. A query isn't its own candidate; rows that repeat an id are candidates each, and a repeated query counts once, with the smallest of its vectors. Fewer candidates than k give fewer rows; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable("v"))
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("largest")
    lengths = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), largest).collect()  # a row for each length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long" + ", evaluated long" * with_evaluated)
    most = max(lengths, key=lambda r: (r["n"], r["d"]))
    d, largest = most["d"], most["largest"] * scale + 1
    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8"
    own = own.where(F.size("v") == d).select("vec_id", "asks", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))
    got = own.select("vec_id", "q").orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(sample).collect()
    some_ids, some = np.array([r["vec_id"] for r in got], np.int64), np.array([r["q"] for r in got], np.int64).reshape(-1, d)
    # Ids may repeat in the sample; one row each keeps the first threshold a true one.
    some_ids, at = np.unique(some_ids, return_index=True)
    some = some[at]
    table = choose_pivots(some, pivots)
    sent = spark.sparkContext.broadcast((table, some_ids, some))  # at most `sample` vectors

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["q"].to_numpy())
                dist = _pivot_distances(x, sent.value[0]).astype(np.float32)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "asks": pdf["asks"], "cell": dist.argmin(1), "norm": _squares(x), "vec": [v.tobytes() for v in x.astype(kind)], "dist": list(dist)})

    held, _ = cut(own.mapInPandas(measure, "vec_id long, asks boolean, cell int, norm double, vec binary, dist array<float>"), "pivots")
    ends = [f(F.col("dist")[p]).alias(f"{f.__name__}{p}") for f in (F.min, F.max) for p in range(len(table))]
    cells = {r["cell"]: r for r in held.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), F.max("norm").alias("norm"), *ends).collect()}  # a row for each pivot at most
    x_first, x_parts, _ = _lay_out([cells[c]["n"] if c in cells else 0 for c in range(len(table))], block_rows)
    q_first, q_parts, _ = _lay_out([cells[c]["asked"] if c in cells else 0 for c in range(len(table))], block_queries)
    names = sorted(cells)
    low, high = (np.array([[cells[c][f"{f}{p}"] for p in range(len(table))] for c in names], float) for f in ("min", "max"))
    norm = np.array([cells[c]["norm"] for c in names])
    goes = [range(x_first[c], x_first[c] + x_parts[c]) for c in names]

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, sample_ids, sample = sent.value
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                q, dq, ids = _vectors(part["vec"], kind), np.stack(part["dist"].to_numpy()).astype(float), part["vec_id"].to_numpy()
                least = _first_thresholds(ids, q, sample_ids, sample, k)
                able = _bounds(dq, _squares(q), low, high, norm, _reach(table)) >= least[:, None]
                blocks = [sorted({b for c in np.flatnonzero(row) for b in goes[c]}) for row in able]
                yield part.assign(least=least, xb=blocks)[["vec_id", "cell", "vec", "dist", "least", "xb"]]

    asked = held.where("asks").groupBy("vec_id").agg(F.min_by(F.struct("cell", "vec", "dist"), "vec").alias("q")).select("vec_id", "q.*")
    queries = asked.mapInPandas(plan, "vec_id long, cell int, vec binary, dist array<float>, least long, xb array<int>")
    queries = queries.select("vec_id", "vec", "dist", "least", _dealt("cell", "vec_id", q_first, q_parts).alias("qb"), F.explode("xb").alias("xb"))
    queries, _ = cut(queries, "queries")
    candidates = held.select("vec_id", "vec", "dist", _dealt("cell", "vec_id", x_first, x_parts).alias("block"))
    candidates = candidates.join(queries.select(F.col("qb").alias("to"), F.col("xb").alias("block")).distinct(), "block")

    def run(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="Int64")
        table, ids, sample = sent.value
        stats: list[int] = []
        dq, dx = (np.stack(v["dist"].to_numpy()).astype(float) for v in (qs, xs))
        found = search(qs["vec_id"].to_numpy(), _vectors(qs["vec"], kind), xs["vec_id"].to_numpy(), _vectors(xs["vec"], kind), table, ids, sample, k, stats, dq, dx, qs["least"].to_numpy())
        counts = list(zip(qs["vec_id"].tolist(), [None] * len(stats), stats)) if with_evaluated else []
        return pd.DataFrame(found + counts, columns=["query_id", "vec_id", "score"], dtype="Int64")

    found = queries.groupBy("qb", "xb").cogroup(candidates.groupBy("to", "block")).applyInPandas(run, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if not with_evaluated:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    found, _ = cut(found, "found")
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(found.where("vec_id is null").groupBy("query_id").agg(F.sum("score").alias("evaluated")), "query_id").select("query_id", F.col("rank").cast("int"), "vec_id", "score", "evaluated")


def _vectors(packed: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.int64)
