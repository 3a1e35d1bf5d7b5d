"""A folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir, removed when the application ends; in local runs where that is unset, under a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/noisefold-{what}-{uuid.uuid4().hex}"
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(found)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The folders directly in `folder` whose write was finished (they have the success mark), by name; none where it doesn't exist."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
