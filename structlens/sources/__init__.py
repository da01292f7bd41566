"""Readers of file trees, class files, sources, reports and dependency manifests."""
