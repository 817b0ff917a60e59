"""Timed-text sources."""
