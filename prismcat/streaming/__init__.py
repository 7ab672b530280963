"""Incremental variants of the batch ingest."""
