"""Spark-native engine for time-resolved network analysis over long panels and edge lists."""
