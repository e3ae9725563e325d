"""Spark-native code and document navigation: index, search, relate, evaluate."""
