"""A Spark-native engine for text statistics, vector analytics and replica reconciliation."""
