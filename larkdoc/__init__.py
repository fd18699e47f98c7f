"""A Spark-native engine for queries over collections of typed documents."""
