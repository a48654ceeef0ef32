"""Spark-native engine for bitemporal, multi-observer facts derived from text."""
