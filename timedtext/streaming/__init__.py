"""Timed-text streaming."""
