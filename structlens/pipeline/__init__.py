"""Tasks, their state and their scheduler."""
