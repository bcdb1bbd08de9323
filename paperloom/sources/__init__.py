"""Readers and writers: document trees, JSON lines, typed Parquet tables."""
