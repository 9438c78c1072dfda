"""The chain of versions of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def version_history(log: DataFrame, *, key: str = "key", ts: str = "ts", seq: str = "seq", value: str = "value") -> DataFrame:
    """Every version with valid_to (when the next one replaced it; null: never) and the value before it."""
    chain = Window.partitionBy(key).orderBy(ts, seq)
    return log.withColumn("valid_to", F.lead(ts).over(chain)).withColumn("prev_value", F.lag(value).over(chain))
