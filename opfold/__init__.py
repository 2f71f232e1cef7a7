"""A PySpark-native analytics engine for multi-writer operation logs."""
