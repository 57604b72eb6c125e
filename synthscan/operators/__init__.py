"""Aggregations over token scores, and evaluation."""
