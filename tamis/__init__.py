"""tamis: a PySpark-native engine for finding, classifying and scoring sensitive data."""

__version__ = "0.1.0"
