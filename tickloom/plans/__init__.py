"""Whole pipelines over series, and the registered queries."""
