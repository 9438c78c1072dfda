"""The kernel: which version of each key a snapshot sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PUT


def resolve(log: DataFrame, as_of=None, *, key: str = "key", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest version of each key at or before as_of (None: of all), tombstones included.

    The time filter stands below the window, so that it reaches the scan. row_number() = 1 becomes a group limit on
    both sides of the one shuffle: of a hot key each map task sends on one row.
    """
    seen = log if as_of is None else log.where(F.col(ts) <= as_of)
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(seq).desc())
    return seen.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def live(log: DataFrame, as_of=None, *, op: str = "op", **cols) -> DataFrame:
    """What a reader of the snapshot sees. The tombstones go after resolve(): before it, deleted keys would come back."""
    return resolve(log, as_of, **cols).where(F.col(op) == PUT)


def latest_ts_by_key(log: DataFrame, as_of=None, *, key: str = "key", ts: str = "ts") -> DataFrame:
    """Where only times are asked for, a hash aggregate does without the sort."""
    seen = log if as_of is None else log.where(F.col(ts) <= as_of)
    return seen.groupBy(key).agg(F.max(ts).alias(ts))
