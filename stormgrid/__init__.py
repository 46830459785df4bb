"""Spark-native operators for gridded storm observations."""
