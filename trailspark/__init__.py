"""A PySpark-native log investigation engine."""
