"""Incremental checks over arriving records."""
