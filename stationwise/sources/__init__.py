"""Readers: raw text layouts, CSV lookups and Parquet tables."""
