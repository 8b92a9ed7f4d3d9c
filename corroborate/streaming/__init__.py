"""Operators that also run on streams."""
