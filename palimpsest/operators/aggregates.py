"""Counts, bounds, sizes and scores: aggregates of a log, of a snapshot, or of the runs' table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.resolve import resolve
from ..schema import DELETE, PUT


def count_live(log: DataFrame, as_of=None, *, op: str = "op", **cols) -> DataFrame:
    """Live keys and keys whose visible version is a tombstone."""
    return resolve(log, as_of, **cols).agg(F.count_if(F.col(op) == PUT).alias("live_count"), F.count_if(F.col(op) == DELETE).alias("delete_count"))


def min_max(df: DataFrame, *, key: str = "key", value: str | None = "value") -> DataFrame:
    """Smallest and largest key, with their values; over live() or, to count tombstones too, over resolve()."""
    out = [F.min(key).alias("min_key"), F.max(key).alias("max_key")]
    if value:
        out += [F.min_by(value, key).alias("min_value"), F.max_by(value, key).alias("max_value")]
    return df.agg(*out)


def latest_ts(log: DataFrame, *, ts: str = "ts") -> DataFrame:
    return log.agg(F.max(ts).alias("latest_ts"))


def entry_bytes(key: str = "key", value: str = "value"):
    """Bytes of an entry; a tombstone counts its key only."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def run_stats(log: DataFrame, *, run: str = "run_id", key: str = "key", ts: str = "ts", size=None) -> DataFrame:
    """Key bounds, entries, bytes and newest time of each run, in one aggregate."""
    return log.groupBy(run).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("entry_count"), F.sum(entry_bytes() if size is None else size).alias("size_bytes"), F.max(ts).alias("max_ts"))


def total_entries(runs: DataFrame) -> DataFrame:
    """Over all runs; a key that stands in several counts in each."""
    return runs.agg(F.coalesce(F.sum("entry_count"), F.lit(0)).alias("total_entries"))


def level_scores(runs: DataFrame, *, base_bytes: int, multiplier: int = 10, size_weight: float = 0.8, count_weight: float = 0.2, threshold: int = 8) -> DataFrame:
    """How full each level is; above 1 it wants compaction. Level 1 holds base_bytes, each next one `multiplier` times more."""
    levels = runs.groupBy("level").agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("run_count"))
    capacity = F.lit(float(base_bytes)) * F.pow(F.lit(float(multiplier)), F.col("level") - 1)
    return levels.withColumn("score", F.col("size_bytes") / capacity * size_weight + F.col("run_count") / threshold * count_weight)
