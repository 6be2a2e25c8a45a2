"""Spark-native record linkage: DataFrame operators for profiling, normalizing, blocking, comparing, deciding and validating."""

__version__ = "0.1.0"
