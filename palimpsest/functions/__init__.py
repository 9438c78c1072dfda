"""Key helpers."""

from .keys import as_bytes, prefix_range, successor, text_successor

__all__ = ["as_bytes", "prefix_range", "successor", "text_successor"]
