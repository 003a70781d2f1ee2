"""lamina: a PySpark-native engine for structural version analytics."""
