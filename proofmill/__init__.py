"""A Spark-native document-audit and corpus-processing engine."""

__version__ = "0.1.0"
