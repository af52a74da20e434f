"""Spark-native text de-duplication and record-linkage engine."""

__version__ = "0.1.0"
