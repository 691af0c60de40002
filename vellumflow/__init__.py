"""Spark-native analytics over document-recognition tables."""
