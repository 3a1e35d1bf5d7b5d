"""Parquet tables and the relations that reports read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefold.operators import stats

RESULTS = "dataset string, method string, eps_tot double, seed int, k int, d int, r int, T int, n int, eps_fs double, eps_topm double, eps_pca double, eps_proxy double, eps_proxy_ratio double, eps_iter double, clip_norm double, proxy_dim int, algo_variant string, config_hash string, runtime_ms_total double, history_path string, score_sensitivity double, score_max double, proxy_sensitivity double, proxy_noise_scale double, pca_noise_scale double, sse_x double, sse_z double, ari double, nmi double, f1 double, non_empty_k_final int, max_cluster_ratio_final double, min_cluster_ratio_final double, cluster_entropy_final double, collapse_final int, collapse_rate double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.features(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, four numeric features and the return flag as class 0..2."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"), flag.alias("label"))


def results_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation with the columns of results, made of events: one row per run."""
    e = table(spark, sf_dir, "events")
    u, i, v = F.col("user_id"), F.col("event_id"), F.col("value")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return e.select(
        i.alias("run_id"),
        pick(["har", "gas"], u).alias("dataset"),
        F.col("event_type").alias("method"),
        pick([0.5, 0.8, 1.0, 1.5], u).alias("eps_tot"),
        (i % 20).cast("int").alias("seed"),
        pick([6, 10], i).alias("k"),
        pick([64, 128, 256], i).alias("d"),
        pick([1000, 5000, 10000], u).alias("n"),
        pick([0.05, 0.1, 0.2], i).alias("eps_proxy_ratio"),
        (v / 500).alias("f1"),
        (v * 37).alias("sse_x"),
        (v / 400).alias("ari"),
        (v / 450).alias("nmi"),
        (v * 3 + 10).alias("runtime_ms_total"),
        (F.floor(v) % 7).cast("int").alias("non_empty_k_final"),
        (v / 600 + 0.1).alias("max_cluster_ratio_final"),
    )


def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation with the columns of history, made of lineitem: a run per order, a row per iteration. run_id matches results_view."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber") - 1).alias("iter"),
        F.col("l_partkey").alias("tie"),
        (F.col("l_discount") + 0.01).alias("eps_t"),
        (F.col("l_tax") + 0.001).alias("drift"),
        (F.col("l_extendedprice") / 1000).alias("noise_scale_sums"),
        (F.col("l_quantity") % 7).cast("int").alias("non_empty_k"),
        (F.col("l_quantity") / 50).alias("max_cluster_ratio"),
        (F.col("l_quantity") / 5000).alias("min_cluster_ratio"),
    )
