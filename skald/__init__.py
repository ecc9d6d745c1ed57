"""Spark-native narration corpus engine."""
