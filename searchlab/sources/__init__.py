"""Readers, writers and staging of intermediate tables."""
