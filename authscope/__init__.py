"""Spark-native analytics over authentication logs."""
