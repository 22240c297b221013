"""A Spark-native analytics engine for capture, pairing and reconstruction tables."""
