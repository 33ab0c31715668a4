"""Readers and writers of series."""
