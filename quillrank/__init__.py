"""Spark-native analytics engine for ranking quality, fairness and profile data."""
