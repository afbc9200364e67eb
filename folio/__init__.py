"""Folio: a Spark-native engine for document collections."""
