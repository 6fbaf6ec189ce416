"""Readers: delimited text, services, Parquet."""
