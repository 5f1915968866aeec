"""Inkwell: a Spark-native engine for text quality at scale."""
