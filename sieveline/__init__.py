"""Spark-native corpus curation, audit and evaluation operators."""

__version__ = "0.1.0"
