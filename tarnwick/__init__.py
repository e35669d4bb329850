"""Spark-native feature, sampling-diagnostics and evaluation engine."""
