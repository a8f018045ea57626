"""A PySpark-native engine that finds, measures and removes repeated content in byte streams."""
