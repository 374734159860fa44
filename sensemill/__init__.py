"""Spark-native analytics for discovering and scoring groupings of observations."""
