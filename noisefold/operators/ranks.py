"""Exact ranks over whole tables, without one task that sorts them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefold.functions import rng

BUCKET = 50_000  # rows that a bucket is to hold
BUCKETS = 1 << 16  # at most; each is a row in the driver


def _in_order(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df without its column _bucket, with a row's place from 0: its place within its bucket and the rows of the buckets before."""
    counts, before, starts = dict(df.groupBy("_bucket").agg(F.count("*").alias("n")).collect()), 0, []
    for b in sorted(counts):
        starts.append((b, before))
        before += counts[b]
    offsets = df.sparkSession.createDataFrame(starts, "_bucket int, _before long")
    here = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return df.join(F.broadcast(offsets), "_bucket").withColumn(name, F.col("_before") + here).drop("_bucket", "_before")  # at most BUCKETS rows


def by_draw(df: DataFrame, name: str, *seed: object) -> tuple[DataFrame, int]:
    """df with each row's place in the order of its keyed draw, ties by row_id, and the number of rows. Draws are uniform, so buckets of equal width hold about as many rows each."""
    n = df.count()
    buckets = min(max(n // BUCKET, 1), BUCKETS)
    drawn = df.withColumn("_u", rng.uniform_col(*seed, F.col("row_id"))).withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    return _in_order(drawn, ["_u", "row_id"], name).drop("_u"), n


def distinct_values(df: DataFrame, col: str, name: str) -> DataFrame:
    """The distinct numbers of a column, nulls left out, with their places in ascending order. Buckets lie between approximate quantiles; the places are exact."""
    values = df.where(F.col(col).isNotNull()).select(col).distinct()
    buckets = min(max(values.count() // BUCKET, 1), 1024)
    bucket: Column = F.lit(0)
    if buckets > 1:
        bounds = sorted(set(values.agg(F.percentile_approx(col, [i / buckets for i in range(1, buckets)], 100 * buckets).alias("q")).first()["q"]))
        bucket = F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda n, b: n + (F.col(col) > b).cast("int"))
    return _in_order(values.withColumn("_bucket", bucket), [col], name)


def tile(place: Column, n: int, tiles: int) -> Column:
    """The tile from 0 of a place among n: equal ones, the first n % tiles with one row more, as ntile() has them."""
    size, more = divmod(n, tiles)
    return F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(more + F.floor((place - more * (size + 1)) / max(size, 1))).cast("int")


def within(df: DataFrame, by: str, col: str, name: str) -> DataFrame:
    """df (distinct by, col) with each row's place from 0 in its group by col. Groups are few and each may be large: rows are ranked in buckets between approximate quantiles of all, and each bucket's counts a group say how many came before."""
    buckets = min(max(df.count() // BUCKET, 1), 1024)
    bucket: Column = F.lit(0)
    if buckets > 1:
        bounds = sorted(set(df.agg(F.percentile_approx(col, [i / buckets for i in range(1, buckets)], 100 * buckets).alias("q")).first()["q"]))
        bucket = F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda n, b: n + (F.col(col) > b).cast("int"))
    dealt = df.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))  # at most 1024 rows a group
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(col)) - 1
    return dealt.withColumn("_here", here).join(offsets, [by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_here")).drop("_bucket", "_before", "_here")
