"""A Spark-native engine for reasoning-trajectory data."""
