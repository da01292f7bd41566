"""Incremental and event-driven operators."""
