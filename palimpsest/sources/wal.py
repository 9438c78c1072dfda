"""The write-ahead log as a source: records of transactions' states, folded to what was committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DELETE, PUT, WAL
from .files import Files


def read_wal(spark: SparkSession, files: Files, first: int = 0) -> DataFrame:
    """Keys and values are base64 text in the records, as JSON has no bytes."""
    names = [x for x in files.names("wal") if x.endswith(".json") and int(x.split("-")[0]) >= first]
    return spark.read.schema(WAL).json([files.at(f"wal/{x}") for x in names]) if names else spark.createDataFrame([], WAL)


def fold(wal: DataFrame) -> DataFrame:
    """One row per transaction: its newest time, whether any record committed or aborted it, and its last operation on each key.

    Later records win key by key, by (wal_id, pos); in one record the writes stand before the deletes.
    """
    keep = ["txn_id", "ts", "committed", "aborted", "wal_id", "pos"]
    puts = wal.select(*keep, F.explode("writes").alias("w")).select(*keep, F.col("w.key").alias("key"), F.col("w.value").alias("value"), F.lit(PUT).alias("op"))
    dels = wal.select(*keep, F.explode("deletes").alias("key")).select(*keep, "key", F.lit(None).cast("string").alias("value"), F.lit(DELETE).alias("op"))
    ops = puts.unionByName(dels).groupBy("txn_id", "key").agg(F.max_by(F.struct("value", "op"), F.struct("wal_id", "pos", "op")).alias("o")).select("txn_id", "key", "o.value", "o.op")
    state = wal.groupBy("txn_id").agg(F.max("ts").alias("ts"), F.bool_or(F.coalesce("committed", F.lit(False))).alias("committed"), F.bool_or(F.coalesce("aborted", F.lit(False))).alias("aborted"))
    return state.join(ops, "txn_id", "left")


def committed_versions(wal: DataFrame) -> DataFrame:
    """What recovery puts back: the writes of committed transactions only."""
    return fold(wal).where(F.col("committed") & ~F.col("aborted") & F.col("key").isNotNull()).select(F.unbase64("key").alias("key"), F.unbase64("value").alias("value"), "ts", "txn_id", F.col("op").cast("tinyint").alias("op"))


def open_transactions(wal: DataFrame) -> DataFrame:
    """Neither committed nor rolled back: to be looked at, never applied."""
    return fold(wal).where(~F.col("committed") & ~F.col("aborted"))
