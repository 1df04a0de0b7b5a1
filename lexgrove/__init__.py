"""Spark-native analytics over governed policy documents."""
