"""Operators of record analyses."""
