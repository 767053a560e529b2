"""A PySpark-native engine for event, interval and call-stack sample tables."""
