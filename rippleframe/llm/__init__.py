"""Operators for preparing large text corpora (deduplication, scoring, packing, archiving)."""
