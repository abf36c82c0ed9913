"""A PySpark-native analytics engine for document and study-material data."""
