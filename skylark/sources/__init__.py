"""Parsers from feed formats to the signal schema."""
