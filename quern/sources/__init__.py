"""Readers of packages and of what they hold."""
