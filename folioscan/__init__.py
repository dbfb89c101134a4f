"""Spark-native engine for watching a literature: library state, candidate feeds, ranking, sinks."""

__version__ = "0.1.0"
