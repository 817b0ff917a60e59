"""Timed-text and media-quality analytics as PySpark DataFrame operators."""
