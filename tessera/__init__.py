"""Spark-native batch analytics engine."""
