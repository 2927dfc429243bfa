"""The per-row operators on files as they arrive."""
