"""A PySpark-native engine for web-archive records."""
