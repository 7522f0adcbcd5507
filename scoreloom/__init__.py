"""Spark-native evaluation of many scoring models against evidence-derived truth."""
