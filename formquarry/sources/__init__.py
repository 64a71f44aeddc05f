"""Scans and sinks of form dumps and of their index files."""
