"""Spark-native tabular data quality, anomaly detection and corpus preparation."""
