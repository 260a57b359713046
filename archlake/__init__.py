"""Spark-native quality and repair of exchange archives, and operators for training-data corpora."""
