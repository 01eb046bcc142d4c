"""Spark-native analytics over collections of financial filings and training text."""

__version__ = "0.1.0"
