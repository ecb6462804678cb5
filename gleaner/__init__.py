"""A Spark-native engine for evidence retrieval over document collections."""
