"""Operators for building training corpora: filters, deduplication, scoring, mixing and packing."""
