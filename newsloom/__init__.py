"""Spark-native analytics over dated text and return panels."""
