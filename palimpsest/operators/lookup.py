"""Many point reads as one join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.resolve import live


def multi_get(log: DataFrame, keys: DataFrame, as_of=None, *, key: str = "key", **cols) -> DataFrame:
    """One row per distinct asked key, with `found`. The log is cut down to those keys before it is resolved.

    The keys' frame is not broadcast by hand: Spark does so by its measured size, and joins by shuffle beyond its bound.
    """
    asked = keys.select(key).distinct()
    hits = live(log.join(asked, key, "left_semi"), as_of, key=key, **cols)
    return asked.join(hits.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lookup_as_of(log: DataFrame, probes: DataFrame, *, key: str = "key", ts: str = "ts", seq: str = "seq", op: str = "op", probe_id: str = "probe_id", probe_ts: str = "probe_ts") -> DataFrame:
    """For each probe (probe_id, key, probe_ts) the version that a reader at its time sees; no row if there is none.

    Probes and versions of a key are laid out on one time line and each probe takes the last version before it, so the
    work is the sum of both sides and not the product that a join on ts <= probe_ts has for a hot key.
    """
    value = F.struct(*[F.col(c) for c in log.columns if c != key])
    events = log.select(F.col(key), F.col(ts).alias("_t"), F.lit(0).alias("_k"), F.col(seq).alias("_s"), value.alias("_v"), F.lit(None).cast(probes.schema[probe_id].dataType).alias(probe_id))
    asks = probes.select(F.col(key), F.col(probe_ts).alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast(log.schema[seq].dataType).alias("_s"), F.lit(None).cast(events.schema["_v"].dataType).alias("_v"), F.col(probe_id))
    line = Window.partitionBy(key).orderBy("_t", "_k", "_s").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.unionByName(asks).withColumn("_v", F.last("_v", ignorenulls=True).over(line)).where("_k = 1")
    return seen.where(F.col("_v").isNotNull() & (F.col(f"_v.{op}") == 0)).select(probe_id, key, F.col("_t").alias(probe_ts), "_v.*")
