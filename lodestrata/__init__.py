"""Spark-native analytics over application-security findings and dependency inventories."""

__version__ = "0.1.0"
