"""Spark-native analytics over object tracks, visits, identity links and their texts."""
