"""Spark-native analytics over typed, multi-table observation data."""

__version__ = "0.1.0"
