"""A PySpark-native analytics library for long, evolving document collections."""
