"""A PySpark-native engine for schema-described records and ordered collections."""
