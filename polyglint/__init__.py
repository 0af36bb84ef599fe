"""Spark-native language identification and text analytics."""
