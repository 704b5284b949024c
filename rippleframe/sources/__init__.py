"""Readers and writers: tables, edge-list text, content hashes, written intermediate tables."""
