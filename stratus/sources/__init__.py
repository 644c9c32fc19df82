"""Readers: raw/enriched observation tables, event streams, driver tables."""
