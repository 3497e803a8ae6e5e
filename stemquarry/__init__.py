"""Spark-native engine for curating, querying, auditing and repairing question-paper corpora."""

__version__ = "0.1.0"
