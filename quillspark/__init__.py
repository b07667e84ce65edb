"""Spark-native analytics over corpora of linked Markdown notes."""
