"""A transaction's own writes over a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, PUT


def overlay_rows(df: DataFrame, *, key: str = "key", value: str = "value", op: str = "op", pos: str = "pos") -> DataFrame:
    """The last operation on each key of a transaction's operations (pos: their order)."""
    return df.groupBy(key).agg(F.max_by(F.struct(F.col(value), F.col(op)), pos).alias("_o")).select(key, f"_o.{value}", f"_o.{op}")


def apply_overlay(snapshot: DataFrame, overlay: DataFrame, *, key: str = "key", value: str = "value", op: str = "op") -> DataFrame:
    """What the transaction itself reads: its puts replace or add keys, its deletes hide them. A null in a put stays one."""
    mine = overlay.select(F.col(key), F.col(value).alias("_value"), F.col(op).alias("_op"))
    both = snapshot.select(key, value).join(mine, key, "full_outer")
    return both.where(F.coalesce(F.col("_op"), F.lit(PUT)) != DELETE).select(key, F.when(F.col("_op").isNotNull(), F.col("_value")).otherwise(F.col(value)).alias(value))
