"""PySpark-native analytics over collections of content and measurements."""
