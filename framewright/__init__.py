"""Spark-native analytics for frame-indexed recordings."""

__version__ = "0.1.0"
