"""Relational and graph operators over flattened code views."""
