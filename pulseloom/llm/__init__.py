"""Operators for training-data pipelines: search, deduplication, filters, mixing, packing, scoring."""
