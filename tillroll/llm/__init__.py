"""Operators for preparing text corpora: filters, deduplication, mixing, token files."""
