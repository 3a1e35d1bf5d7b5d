"""Helpers shared by the operators: shared storage, lineage cuts, connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local runs, where that is unset, a temporary one. A cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="noisefold-")
        atexit.register(_remove_local, _own_dirs[app])
    return _own_dirs[app]


def _remove_local(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name in the shared storage; it goes when the application ends."""
    path = f"{shared_dir(spark)}/noisefold-{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that are done removed: Spark does so when the driver's heap is collected, else rarely. The first collection still finds the last job's references."""
    for wait in (0.2, 0.0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def cut(df: DataFrame, what: str, free: bool = True) -> tuple[DataFrame, str]:
    """Write df to the shared storage and read it back, which ends its lineage. Returns the frame and its folder. With free, files of shuffles that are done go at once: for steps whose shuffles are large against their input."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    if free:
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of the graph with edges (a, b): one row (node, component) for each node that has an edge to another node; component is the smallest node.

    Alternating large-star and small-star steps: every step is an aggregation with map-side combining and an equi-join that adaptive execution can split, so a hub that touches a third of all nodes is no single task. Edges are cut to the shared storage after each round; only counts reach the driver. Self loops and nulls are ignored; repeated edges are harmless.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = cut(e, "edges")
    sign = _signature(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, nxt_path = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_folder(e.sparkSession, path)
        e, path = nxt, nxt_path
        now = _signature(e)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For the undirected edges (i, j) over nodes 0..n-1: each node's smallest reachable node."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        keep = a != b
        if not keep.any():
            break
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even when it is not on their path, and hand them texts in small batches: ten thousand long ones at a time would be most of a worker's memory."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")  # workers are on this machine, in this folder
    if getattr(sc, "_noisefold_shipped", False) or alone and (root in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == root):
        return
    import shutil

    zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="noisefold-zip-"), "noisefold"), "zip", root, "noisefold")
    sc.addPyFile(zipped)
    sc._noisefold_shipped = True
