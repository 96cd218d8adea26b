"""Spark-native auditing and modelling of insertion-reaction data."""
