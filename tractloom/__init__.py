"""Spark-native operators for small-area (tract x year) credit-access analytics."""

__version__ = "0.1.0"
