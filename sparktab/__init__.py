"""Spark-native analytics for understanding tabular data and auditing it for modelling."""
