"""Spark-native analytics for vibration and other uniformly sampled recordings."""
