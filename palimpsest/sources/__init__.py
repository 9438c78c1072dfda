"""Where versions are kept: a folder of sorted runs, a manifest, and a write-ahead log."""

from .files import Files
from .manifest import Manifest
from .runs import read_runs, write_run
from .wal import committed_versions, fold, open_transactions, read_wal

__all__ = ["Files", "Manifest", "committed_versions", "fold", "open_transactions", "read_runs", "read_wal", "write_run"]
