"""A Spark-native engine for research on time-series signals."""
