"""A PySpark-native analytics engine for governed document corpora."""
