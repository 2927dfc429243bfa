"""Readers, writers and the entity views over the warehouse tables."""
