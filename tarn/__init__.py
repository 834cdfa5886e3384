"""A PySpark-native engine for a small SQL dialect with a total order over storage classes."""
