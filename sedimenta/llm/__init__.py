"""Operators on training text."""
