"""Queries over the benchmark tables, with their SQL."""
