"""Spark-native spatial feature store and analytics engine."""
