"""Incremental ingest, duplicate removal and daily totals."""
