"""Spark-native document retrieval, memory and conversation engine."""
