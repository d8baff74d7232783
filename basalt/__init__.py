"""Basalt: a Spark-native SQL analytics engine."""
