"""Spark-native analytics over typed, multilayer dependency graphs."""
