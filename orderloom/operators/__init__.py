"""Reusable operators: order facts, nested documents, contracts, reads and quality checks."""
