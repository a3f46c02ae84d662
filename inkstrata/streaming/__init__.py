"""Incremental ingestion and trends over streams."""
