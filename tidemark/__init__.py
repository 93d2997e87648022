"""Spark-native key-value log, sketch and training-data operators."""
