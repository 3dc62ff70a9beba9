"""Spark-native analysis of redundant data."""
