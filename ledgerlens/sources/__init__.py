"""Readers, writers and the canonical views over the driver tables."""
