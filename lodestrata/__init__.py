"""Spark-native engine for document ingestion, retrieval, redaction and corpus statistics."""
