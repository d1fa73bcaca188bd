"""Spark-native analytics over recordings and timed events."""
