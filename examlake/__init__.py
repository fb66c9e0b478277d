"""Spark-native analytics for assessment documents."""
