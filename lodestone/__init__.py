"""Lodestone: a PySpark-native analytics engine for document-heavy safety data."""
