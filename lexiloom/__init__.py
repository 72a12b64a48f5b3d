"""A Spark-native engine for conversational text analytics."""
