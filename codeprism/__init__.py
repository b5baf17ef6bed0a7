"""Spark-native analytics over source-code and text corpora."""
