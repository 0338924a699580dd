"""Readers for delimited files, JSON, Parquet, conversations, and the file catalog."""
