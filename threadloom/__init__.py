"""Spark-native analytics engine for threaded documents, their authors and their graphs."""
