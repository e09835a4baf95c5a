"""Readers of listings and of record files."""
