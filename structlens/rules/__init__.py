"""Thresholds that turn metrics into findings."""
