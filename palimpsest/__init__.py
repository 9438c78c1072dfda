"""Versioned key-value data on Spark: an append-only log of puts and deletes, read by snapshots."""

from .engine import Engine, Options
from .txn import Cursor, KeyNotFound, Txn

__all__ = ["Cursor", "Engine", "KeyNotFound", "Options", "Txn"]
