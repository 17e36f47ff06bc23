"""A PySpark-native analytics library for labelled event records."""
