"""Continuous ingestion."""

from .ingest import ingest, wal_stream

__all__ = ["ingest", "wal_stream"]
