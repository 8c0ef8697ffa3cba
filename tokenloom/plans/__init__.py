"""Patterns and the DataFrame plans made of them."""
