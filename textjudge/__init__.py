"""PySpark-native evaluation analytics for machine-written text."""
