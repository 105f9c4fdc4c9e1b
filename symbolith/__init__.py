"""Spark-native index and data-processing operators for source-code corpora."""
