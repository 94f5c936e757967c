"""Spark-native knowledge retrieval and corpus analytics."""
