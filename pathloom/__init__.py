"""Spark-native analysis of ordered categorical sequences."""

__version__ = "0.1.0"
