"""Spark-native analytics: noisy clustering of high-dimensional tables, its reports, and data-pipeline operators."""
