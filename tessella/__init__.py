"""Spark-native analytics over colour grids, with operators for training corpora in llm."""
