"""A Spark-native engine for turning noisy, repeated observations into one clean table."""
