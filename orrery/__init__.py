"""Orrery: a Spark-native analytics engine for observation data."""
