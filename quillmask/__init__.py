"""Spark-native profiling, masking and test-data generation."""
