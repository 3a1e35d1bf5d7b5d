"""Connected components of graphs too large for one task: joins that contract the graph, and pointer jumping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.sources import storage

ROUNDS = 64  # each contraction at least halves what is left in two rounds


def _kept(df: DataFrame, what: str, folders: list[str]) -> DataFrame:
    """df written to the shared folder and read back: lost executors don't repeat the rounds before."""
    path = storage.new_folder(df.sparkSession, what)
    df.write.parquet(path)
    folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark, folders: list[str], keep: int = 0) -> None:
    while len(folders) > keep:
        storage.drop_folder(spark, folders.pop(0))


def _jumped(parents: DataFrame, by: Sequence[str], folders: list[str]) -> DataFrame:
    """(by, node, root) of trees (by, node, parent): each node takes its parent's parent until none changes, so a path of n nodes takes log2(n) joins."""
    up = parents.withColumnRenamed("parent", "root")
    for _ in range(ROUNDS):
        over = up.select(*by, F.col("node").alias("root"), F.col("root").alias("_next"))
        up = _kept(up.join(over, [*by, "root"], "left").select(*by, "node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "jumps", folders)
        moved = not up.where("moved").isEmpty()
        up = up.drop("moved")
        if not moved:
            return up
    raise RuntimeError(f"trees deeper than 2^{ROUNDS}")


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For some nodes of one task, each one's smallest node in its tree: root after the links (i, j) were added, each node directly under it."""
    root = root.copy()
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not ((up := root[root]) == root).all():
            root = up


def components(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, node, component) for every node of a link (by, a, b) to another node; component is the smallest node that it reaches within its group.

    A round hangs each node that has a smaller neighbour under the smallest, an aggregate with map-side combining; the trees become stars by pointer jumping; and links are rewritten between roots, so the graph shrinks until no link is left. Then each round's roots are looked up in the later rounds' stars. Nothing but emptiness reaches the driver. Self loops and nulls are left out, repeated links are harmless, an empty table gives no rows.
    """
    by, spark = list(by), links.sparkSession
    folders: list[str] = []
    edges = links.where("a is not null and b is not null and a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = _kept(edges, "links", folders)
    stars, held = [], []
    for _ in range(ROUNDS):
        if edges.isEmpty():
            break
        trees = edges.groupBy(*by, F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        star = _kept(_jumped(_kept(trees, "trees", folders), by, folders), "stars", held)
        stars.append(star)
        to = lambda c: star.select(*by, F.col("node").alias(c), F.col("root").alias(f"_{c}"))  # noqa: B023, E731
        moved = edges.join(to("a"), [*by, "a"]).join(to("b"), [*by, "b"], "left").select(*by, F.col("_a").alias("a"), F.coalesce("_b", "b").alias("b"))
        edges = _kept(moved.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", folders)
        _drop(spark, folders, 1)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    _drop(spark, folders)
    empty = spark.createDataFrame([], links.select(*by, F.col("a").alias("node"), F.col("b").alias("component")).schema)
    if not stars:
        return empty
    found = stars[-1].withColumnRenamed("root", "component")
    for star in reversed(stars[:-1]):  # a root of this round may hang under another in a later one
        later = found.select(*by, F.col("node").alias("root"), "component")
        found = star.join(later, [*by, "root"], "left").select(*by, "node", F.coalesce("component", "root").alias("component")).unionByName(found)
    roots = found.select(*by, F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots)
