"""Spark-native search and web analytics."""
