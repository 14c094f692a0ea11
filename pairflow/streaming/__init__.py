"""Incremental ingestion (section 2.12)."""
