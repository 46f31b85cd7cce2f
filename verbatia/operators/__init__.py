"""Operators over token, corpus and span tables."""
