"""Series as streams."""
