"""Relational operators over program facts."""
