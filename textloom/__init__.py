"""A Spark-native engine for analytics over collections of documents."""
