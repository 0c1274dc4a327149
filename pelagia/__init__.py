"""Spark-native analytics for amplicon count matrices, sample context and execution traces."""

__version__ = "0.1.0"
