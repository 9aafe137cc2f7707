"""A PySpark-native engine for near-duplicate detection and record linkage."""
