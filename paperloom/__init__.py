"""Spark-native engine for scientific literature as data."""
