"""Operators over sessions and texts."""
