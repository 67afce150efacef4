"""Spark-native analytics for biometric evaluation data."""
