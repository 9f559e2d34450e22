"""A Spark-native engine for time-coded records, names and texts."""
