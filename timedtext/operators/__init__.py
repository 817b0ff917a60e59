"""Timed-text operators."""
