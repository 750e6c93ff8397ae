"""Relational operators over events and minute buckets."""
