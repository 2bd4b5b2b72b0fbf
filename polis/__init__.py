"""Polis: Spark-native analytics over public-policy data."""
