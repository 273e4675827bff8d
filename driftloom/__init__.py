"""Spark-native auditing of how graphs extracted from text drift between extraction setups."""
