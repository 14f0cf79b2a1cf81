"""A Spark-native analytics engine for surface-inspection imagery."""
