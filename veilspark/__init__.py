"""Spark-native PII detection, routing, redaction and evaluation."""
