"""Operators that prepare text corpora for training. Nothing else in tickloom imports this subpackage."""
