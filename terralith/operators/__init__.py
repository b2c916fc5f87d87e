"""Operators over DataFrames of tagged elements."""
