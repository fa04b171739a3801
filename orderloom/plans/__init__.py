"""Analytic marts, request-time aggregates, and the batch build that writes them."""
