"""Spark-native analytics for spatial sampling, patches and model evaluation."""
