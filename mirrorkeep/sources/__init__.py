"""Readers and parsers that turn cluster documents into flat tables."""
