"""Operators over series tables (token_id, datetime, seq, price)."""
