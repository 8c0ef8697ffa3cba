"""Operators on matches."""
