"""tessella: a PySpark-native engine for multi-label document-coding studies."""
