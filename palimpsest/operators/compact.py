"""Merging runs, and the choice of what to merge.

The merges are plans over whole runs. The choices work on the runs' metadata, a few rows per run that the manifest
holds anyway, so they are plain functions; those that are set-shaped have a DataFrame form as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.resolve import resolve
from ..schema import PUT


def merge_runs(log: DataFrame, **cols) -> DataFrame:
    """Newest version of each key over the given runs; tombstones stay, as an older run outside may hold the key."""
    return resolve(log, **cols)


def retain(log: DataFrame, retain_after: int | None, *, key: str = "key", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """What snapshots at or after retain_after can still see: all newer versions, and the newest at or before it.

    None keeps every version. Merging with this instead of merge_runs() leaves older readers their answers.
    """
    if retain_after is None:
        return log
    return log.where(F.col(ts) > retain_after).unionByName(resolve(log, retain_after, key=key, ts=ts, seq=seq).select(log.columns))


def drop_tombstones(merged: DataFrame, others: DataFrame | None = None, *, key: str = "key", op: str = "op", bounds: Sequence[tuple] | None = None) -> DataFrame:
    """Drops those tombstones that hide nothing: no other run (or open batch) can hold the key.

    others: runs' metadata (min_key, max_key). They are few, so their bounds become a filter, and the rows of the runs
    themselves need not be read.
    """
    if bounds is None:
        bounds = [] if others is None else [(r.min_key, r.max_key) for r in others.select("min_key", "max_key").collect()]
    hidden = F.lit(False)
    for low, high in bounds:
        hidden = hidden | F.col(key).between(F.lit(low), F.lit(high))
    return merged.where((F.col(op) == PUT) | hidden)


def overlap_pairs(runs: DataFrame, *, run: str = "run_id") -> DataFrame:
    """Pairs of runs with overlapping key ranges: a nested loop over metadata, whose one side is broadcast if a count allows."""
    a, b = runs.select(F.col(run).alias("run_a"), F.col("min_key").alias("a_min"), F.col("max_key").alias("a_max")), runs.select(F.col(run).alias("run_b"), F.col("min_key").alias("b_min"), F.col("max_key").alias("b_max"))
    if b.limit(100_001).count() <= 100_000:
        b = F.broadcast(b)
    return a.join(b, (F.col("run_a") < F.col("run_b")) & (F.col("a_max") >= F.col("b_min")) & (F.col("a_min") <= F.col("b_max"))).select("run_a", "run_b")


def key_range_groups(runs: DataFrame, *, run: str = "run_id", within: Sequence[str] = ()) -> DataFrame:
    """Numbers runs by groups that touch: a new group starts where min_key is above the max_key of the run before."""
    by = Window.partitionBy(*within).orderBy("min_key", run)
    return runs.withColumn("_new", F.coalesce((F.col("min_key") > F.lag("max_key").over(by)).cast("int"), F.lit(0))).withColumn("group_id", F.sum("_new").over(by)).drop("_new")


def oldest_until(runs: DataFrame, share: float, *, run: str = "run_id", within: Sequence[str] = ()) -> DataFrame:
    """The oldest runs until they make up `share` of all bytes (the run that reaches it included)."""
    by = Window.partitionBy(*within).orderBy("max_ts", run)
    before = F.coalesce(F.sum("size_bytes").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.withColumn("_before", before).withColumn("_all", F.sum("size_bytes").over(Window.partitionBy(*within))).where(F.col("_before") < F.col("_all") * share).drop("_before", "_all")


def pick_size_tiered(sizes: Sequence[tuple[int, int]], *, threshold: int = 8, batch: int = 8, similarity: float = 1.5) -> list[int]:
    """Of (run_id, bytes): the first group of similar sizes, from the smallest on, or else the smallest `batch`."""
    if len(sizes) < threshold:
        return []
    ordered = sorted(sizes, key=lambda x: (x[1], x[0]))
    for i, (_, base) in enumerate(ordered):
        group = [r for r, s in ordered[i : i + batch] if base and s / base <= similarity]
        if len(group) >= 2:
            return group
    return [r for r, _ in ordered[:batch]]


def pick_leveled(level: Sequence[dict], below: Sequence[dict]) -> tuple[int, list[int]] | None:
    """A run to push down (one with a single key if there is one, else the first) and what it overlaps one level below."""
    if not level:
        return None
    chosen = next((r for r in level if r["min_key"] == r["max_key"]), level[0])
    return chosen["run_id"], [r["run_id"] for r in below if r["max_key"] >= chosen["min_key"] and r["min_key"] <= chosen["max_key"]]


def distribute_groups(sizes: Sequence[int], share: float = 0.7) -> tuple[list[int], list[int]]:
    """Deals groups (by index) to the level above while that stays within `share` of all bytes, else one higher still."""
    total, used, upper, lower = sum(sizes), 0, [], []
    for i, s in enumerate(sizes):
        if used + s <= total * share:
            used += s
            upper.append(i)
        else:
            lower.append(i)
    return upper, lower
