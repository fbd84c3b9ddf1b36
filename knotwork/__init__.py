"""Knotwork: a PySpark-native record-linkage and analytics engine."""

__version__ = "0.1.0"
