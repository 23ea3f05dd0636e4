"""A PySpark-native engine for document and activity analytics."""
