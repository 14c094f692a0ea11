"""Readers, writers and the block-text source (section 2.1)."""
