"""Operator 8: SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A fingerprint's 64 bits are a path in a binary trie. Node pairs are traversed together from the root: each level adds the differing bit to a pair's count, and a pair over its budget is dropped with all below it. Two fingerprints with at most `bits` differing bits have at most bits // 2 of them in one of their two halves, so the trie is joined twice, once with either half in front, with the budget bits // 2 through the front half and `bits` below. That keeps the pairs per node at the square of log(n), not its fourth power.

The trie's top is dealt over tasks: a task owns one page (a prefix of `depth` bits) and receives the fingerprints of the pages that are at most bits // 2 bits away. What each page would get is counted first, from the pages' own counts; a page that would get more than usual is parted by further bits of its half, and what comes to it goes to those parts that are within what is left of the budget. Its links leave as a spanning forest, so rows out never outgrow rows in, however dense a group of near copies is. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from noisefold.llm.common import components, cut, forest

SHINGLE_WORDS = 4
SEED = 42
BITS = 4


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (A-Z lowered, words split at ASCII white space); 0 for no words."""
    words = (text or "").encode().lower().split()
    if len(words) <= SHINGLE_WORDS:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
    n = len(words) - SHINGLE_WORDS + 1
    h = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):  # long texts in steps: memory stays flat
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long. A null text counts as empty (fingerprint zero)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "text_hash": pdf["text_hash"].array, "fp": np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)})

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, text_hash long, fp long")


def trie_links(values: np.ndarray, home: int, front: int, budget: int, most: int = 1 << 20) -> np.ndarray:
    """Labels of a spanning forest over sorted distinct uint64 values: links between values[:home] and all of them.

    Pairs of trie nodes are index ranges in the sorted array. budget bits may differ in all, front of them in the upper half.
    """
    n = len(values)
    held_i: list[np.ndarray] = []
    held_j: list[np.ndarray] = []
    label = np.arange(n)

    def hold(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        held_i.append(i)
        held_j.append(j)
        if sum(map(len, held_i)) > most:
            label = forest(n, np.concatenate([np.arange(n), *held_i]), np.concatenate([label, *held_j]))
            held_i.clear()
            held_j.clear()

    todo = [(0, *(np.array([x]) for x in (0, home, 0, n, 0)))]
    while todo:
        depth, a0, a1, b0, b1, diff = todo.pop()
        if len(a0) > most:  # depth first: half of a wide frontier waits
            half = len(a0) // 2
            todo += [(depth, *(x[half:] for x in (a0, a1, b0, b1, diff))), (depth, *(x[:half] for x in (a0, a1, b0, b1, diff)))]
            continue
        few = (a1 - a0) * (b1 - b0) <= 16
        if depth == 64:
            few[:] = True
        if few.any():  # small pairs of nodes: their leaves are compared at once
            size = ((a1 - a0) * (b1 - b0))[few]
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = np.repeat((b1 - b0)[few], size)
            i, j = np.repeat(a0[few], size) + k // width, np.repeat(b0[few], size) + k % width
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            hold(i[near], j[near])
            a0, a1, b0, b1, diff = (x[~few] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am, a1, b0, bm, diff + 1)]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts))
        keep = (a0 < a1) & (b0 < b1) & (diff <= (front if depth < 32 else budget)) & ((b0 >= home) | (b1 > a0))
        a0, a1, b0, b1, diff = (x[keep] for x in (a0, a1, b0, b1, diff))
        if len(a0):
            todo.append((depth + 1, a0, a1, b0, b1, diff))
    return forest(n, np.concatenate([np.arange(n), *held_i]), np.concatenate([label, *held_j]))


HALF = 32  # bits of either half


def _masks(width: int, most: int) -> list[int]:
    """The numbers of `width` bits with at most `most` ones."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)]


def trie_self_join(fps: DataFrame, bits: int = BITS, page_rows: int = 50_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp (signed longs) that connect exactly what links of at most `bits` bits connect."""
    n = max(1, fps.count())
    depth = min(20, max(8, math.ceil(math.log2(n / page_rows)) if n > page_rows else 0))
    front = bits // 2
    masks = _masks(depth, front)
    turned = fps.select(F.explode(F.array(*(F.struct(F.lit(r).alias("turn"), v.alias("v")) for r, v in ((0, F.col("fp")), (1, F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))))))).alias("x")).select("x.*")
    turned = turned.withColumn("own", F.shiftrightunsigned("v", 64 - depth).cast("int"))
    around = lambda df: df.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).withColumn("page", F.col("own").bitwiseXOR(F.col("mask"))).where("page <= own")
    usual = page_rows * len(masks)
    loads = around(turned.groupBy("turn", "own").agg(F.count("*").alias("n"))).groupBy("turn", "page").agg(F.sum("n").alias("n"))  # at most 2 ** depth counts a turn, each sent to its pages
    hot = loads.where(F.col("n") > usual).select("turn", "page", F.least(F.lit(HALF - depth), F.ceil(F.log2(F.col("n") / usual))).cast("int").alias("extra"))
    hot, _ = cut(hot, "pages", free=False)
    dealt = around(turned)
    if hot.isEmpty():
        dealt = dealt.select("turn", "v", "page", F.lit(0).alias("extra"), F.lit(0).alias("part"))
    else:
        dealt = dealt.join(F.broadcast(hot), ["turn", "page"], "left").withColumn("extra", F.coalesce("extra", F.lit(0)))  # at most 2 ** 21 pages
        left = front - F.bit_count("mask")
        all_parts = F.coalesce(*(F.when(F.col("extra") == e, F.array(*map(F.lit, _masks(e, front)))) for e in range(HALF - depth + 1)))
        at = F.when(F.col("extra") > 0, F.expr(f"shiftrightunsigned(shiftleft(v, {depth}), 64 - extra)")).otherwise(F.lit(0)).cast("int")
        dealt = dealt.withColumn("at", at).withColumn("part_mask", F.explode(F.filter(all_parts, lambda x: F.bit_count(x) <= left)))
        dealt = dealt.withColumn("part", F.col("at").bitwiseXOR(F.col("part_mask"))).where("page < own or part <= at").select("turn", "v", "page", "extra", "part")

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        turn, page, extra, part = map(int, key)
        values = np.unique(pdf["v"].to_numpy(np.int64).view(np.uint64))
        width, prefix = depth + extra, (page << extra) + part + 1
        home = int(np.searchsorted(values, np.uint64(prefix << (64 - width)))) if prefix < 1 << width else len(values)
        if not home:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        label = trie_links(values, home, front, bits)
        i = np.flatnonzero(label != np.arange(len(label)))
        a, b = values[i], values[label[i]]
        if turn:
            a, b = ((x << np.uint64(HALF)) | (x >> np.uint64(HALF)) for x in (a, b))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("turn", "page", "extra", "part").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links of at most `bits` differing bits), text_hash, and leads: whether id and text hash are the first of its component (ids ascending, none last).

    Null and empty texts have fingerprint zero and link like any other; a null doc_id stays a row of its own and never names a component unless the component has no other id (then null). Repeated rows are kept as they are. Other columns of docs are ignored. An empty table gives no rows.
    """
    fps, _ = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = fps.groupBy("fp").agg(F.min(key).alias("first"))
    comp = components(trie_self_join(first.select("fp"), bits))
    of = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    of, _ = cut(of, "classes")
    least = of.groupBy("component").agg(F.min("first").alias("least"))
    of = of.join(least, "component").select("fp", "least")
    leads = (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("leads")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"), "text_hash", leads)
