"""Spark-native scoring of texts for machine authorship, and evaluation of the scores."""

__version__ = "0.1.0"
