"""A Spark-native hybrid retrieval and corpus-maintenance engine."""

__version__ = "0.1.0"
