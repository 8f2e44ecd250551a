"""Spark-native analytics over knowledge graphs built from text."""
