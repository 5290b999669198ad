"""Spark-native unification of messy multi-source sales data."""
