"""Spark-native preparation, auditing and measuring of text-training corpora."""
