"""Expressions over ordered series."""
