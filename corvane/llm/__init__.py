"""Operators on training text and code. Nothing outside this package imports it."""
