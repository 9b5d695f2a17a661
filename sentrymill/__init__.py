"""Spark-native behavioural surveillance analytics."""
