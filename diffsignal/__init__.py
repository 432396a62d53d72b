"""diffsignal: a PySpark-native engine for review-style workloads over text and code."""
