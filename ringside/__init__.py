"""Ringside: a PySpark-native engine for point-in-time contest analytics."""
