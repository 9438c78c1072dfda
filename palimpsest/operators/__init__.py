"""Relational operators beside the scans: lookups, history, overlays, aggregates and compaction."""

from .aggregates import count_live, latest_ts, level_scores, min_max, run_stats, total_entries
from .compact import drop_tombstones, merge_runs, pick_leveled, pick_size_tiered, retain
from .history import version_history
from .lookup import lookup_as_of, multi_get
from .overlay import apply_overlay, overlay_rows

__all__ = ["apply_overlay", "count_live", "drop_tombstones", "latest_ts", "level_scores", "lookup_as_of", "merge_runs", "min_max", "multi_get", "overlay_rows", "pick_leveled", "pick_size_tiered", "retain", "run_stats", "total_entries", "version_history"]
