"""Operators for large training-data pipelines: filters, deduplication, tokenizing and packing of documents."""
