"""Readers, writers and names of stored tables."""
