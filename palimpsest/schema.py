"""The version log: one row for each put or delete that was ever committed."""

from pyspark.sql import types as T

PUT, DELETE = 0, 1

VERSION_LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("ts", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("txn_id", T.LongType(), True),
    ]
)

#: What the engine keeps of each sorted run.
RUNS = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("min_key", T.BinaryType(), True),
        T.StructField("max_key", T.BinaryType(), True),
        T.StructField("entry_count", T.LongType(), False),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("max_ts", T.LongType(), True),
    ]
)

#: One record per commit, rollback or saved state of an open transaction.
WAL = T.StructType(
    [
        T.StructField("wal_id", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("txn_id", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("committed", T.BooleanType()),
        T.StructField("aborted", T.BooleanType()),
        T.StructField("writes", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("deletes", T.ArrayType(T.StringType())),
    ]
)
