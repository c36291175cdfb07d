"""Spark-native curation and analytics over multimodal record manifests."""

__version__ = "0.1.0"
