"""A PySpark-native engine for vector collections."""
