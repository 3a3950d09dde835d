"""Readers, writers and the metadata lookups around them."""
