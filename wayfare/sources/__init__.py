"""Readers, writers, schemas and the adapters over the provided tables."""
