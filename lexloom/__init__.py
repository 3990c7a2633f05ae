"""Spark-native analytics over French administrative orders: lines, sections, references, operations."""

__version__ = "0.1.0"
