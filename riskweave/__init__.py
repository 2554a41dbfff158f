"""Spark-native text-risk analytics: detection, event processing, evaluation and corpus preparation."""
