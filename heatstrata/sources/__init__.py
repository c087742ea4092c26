"""Readers, writers, schemas and the shared work folder."""
