"""Spark-native analytics over document corpora: text context, concepts, retrieval, learning paths and mastery."""
