"""Operators for preparing training data: mixing, formatting, packing, filtering and deduplication."""
