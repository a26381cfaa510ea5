"""Spark-native analytics over market-style series, events and text."""
