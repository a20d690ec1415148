"""Operators as SQL functions."""
