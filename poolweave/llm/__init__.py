"""Operators for building training corpora: filters, duplicates, tokens, packing and search."""
