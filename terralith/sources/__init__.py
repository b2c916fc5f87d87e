"""Readers of geographic files."""
