"""CSV and document sinks."""
