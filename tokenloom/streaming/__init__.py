"""Scans of files that arrive in chunks."""
