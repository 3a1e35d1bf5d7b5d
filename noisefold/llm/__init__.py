"""Operators for training-data pipelines. Nothing else in noisefold imports this subpackage."""
