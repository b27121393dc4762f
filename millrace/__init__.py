"""millrace: a Spark-native engine for document corpora, search indexes and message streams."""

__version__ = "0.1.0"
