"""A PySpark-native engine for point-cloud registration, pose analytics and text corpora."""
