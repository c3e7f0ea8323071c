"""Spark-native detection, pseudonymisation and restoration of personal data in text."""
