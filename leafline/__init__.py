"""Spark-native document-layout and recognised-text analytics."""
