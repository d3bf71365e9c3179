"""Spark-native analytics for (entity x date) panels, group flows and report corpora."""

__version__ = "0.1.0"
