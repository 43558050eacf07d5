"""PySpark-native analytics over content-addressed key-value cache objects."""
