"""Text files as numbered lines, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, paths: str) -> DataFrame:
    """path, line, value of the text files that a glob names; lines count from 0 in each file.

    Files are read in splits, as large as they are. A first scan counts each split's lines, sums over a file's earlier splits (a row per split) say where a split's lines begin, and the second scan numbers its lines from there. No line is shuffled for its number while the splits' table is small enough for the optimizer to broadcast.
    """
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(splits.drop("_n"), ["path", "_block"]).select("path", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line"), "value")
