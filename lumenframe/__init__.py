"""Spark-native analytics over sparse detector frames."""

__version__ = "0.1.0"
