"""Structured Streaming into the store: each micro-batch becomes a run, then compaction has its turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..schema import WAL


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """stream: rows (key, value, op[, ts, seq]). A batch that is run again after a failure is written once, as its number is
    published in the same state of the manifest as its rows. The checkpoint's path names the stream."""

    def one(batch: DataFrame, batch_id: int) -> None:
        if engine.manifest.batches.get(checkpoint, -1) < batch_id:
            engine.append(batch, batch=(checkpoint, batch_id))
        engine.compact_if_needed()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def wal_stream(spark: SparkSession, engine: Engine) -> DataFrame:
    """The write-ahead log as a stream of records."""
    return spark.readStream.schema(WAL).json(engine.files.at("wal"))
