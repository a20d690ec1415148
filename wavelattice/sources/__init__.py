"""Readers, writers and parsers of media files."""
