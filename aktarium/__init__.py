"""A PySpark-native engine for permission-scoped document archives."""
