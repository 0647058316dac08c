"""A Spark-native engine for evolving graphs."""
