"""Spark-native analytics over serialised fiction and large text collections."""
