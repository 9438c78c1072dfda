"""Sorted runs as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import run_stats
from ..schema import VERSION_LOG
from .files import Files


def write_run(log: DataFrame, files: Files, run_id: int, level: int, *, bloom: bool = True, ndv: int | None = None, partitions: int | None = None) -> dict:
    """Writes one run, range-partitioned and sorted by key, and returns its metadata, read from what was written.

    Sorted files give narrow row-group bounds, so that point, range and prefix reads skip most of the run; the bloom
    filter over all keys (tombstones too) helps where the bounds can't.
    """
    path = files.at(f"runs/{run_id:012d}")
    dealt = log.repartitionByRange(partitions, "key") if partitions else log.repartitionByRange("key")
    out = dealt.sortWithinPartitions("key", F.col("ts").desc(), F.col("seq").desc()).write.mode("overwrite")
    if bloom:
        out = out.option("parquet.bloom.filter.enabled#key", "true")
        if ndv:
            out = out.option("parquet.bloom.filter.expected.ndv#key", str(ndv))
    out.parquet(path)
    spark = log.sparkSession
    stats = run_stats(spark.read.schema(VERSION_LOG).parquet(path).withColumn("run_id", F.lit(run_id)))
    row = stats.collect()
    if not row:
        return {"run_id": run_id, "level": level, "min_key": None, "max_key": None, "entry_count": 0, "size_bytes": 0, "max_ts": None}
    return {"level": level} | {k: bytes(v) if isinstance(v, bytearray) else v for k, v in row[0].asDict().items()}


def read_runs(spark: SparkSession, files: Files, run_ids: list[int]) -> DataFrame:
    """The rows of the given runs, as one scan."""
    if not run_ids:
        return spark.createDataFrame([], VERSION_LOG)
    return spark.read.schema(VERSION_LOG).parquet(*[files.at(f"runs/{i:012d}") for i in run_ids])
