"""Plans over the version log; all build on resolve()."""

from .resolve import latest_ts_by_key, live, resolve
from .scan import first_at_or_after, first_key, full_scan, last_at_or_before, last_key, page, prefix_scan, range_scan

__all__ = ["first_at_or_after", "first_key", "full_scan", "last_at_or_before", "last_key", "latest_ts_by_key", "live", "page", "prefix_scan", "range_scan", "resolve"]
