"""Relational operators over messages, latencies and series."""
