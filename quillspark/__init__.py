"""Spark-native analytics for large corpora of rated, time-stamped short texts."""
