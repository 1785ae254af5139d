"""Spark-native analytics for recordings and the tables around them."""
