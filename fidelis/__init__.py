"""A Spark-native trust engine for recorded sensor and robot datasets."""
