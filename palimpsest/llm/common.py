"""What several operators share: tables in the shared folder, checked joins, words, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after a count shows that it has no more rows than this (of a few numbers each).
BROADCAST_ROWS = 500_000
#: And whose strings have no more bytes in all than this.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir. Where that is unset, a temporary folder is made if all runs on one
    machine; on a cluster that is an error, as executors wouldn't see it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        own = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, own, True)
        root = f"file://{own}"
    return f"{root.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def written(df: DataFrame, *, compression: str = "zstd", **options: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends here, and a lost executor costs no rerun of what came before.
    The table is deleted when the application ends."""
    path = shared_folder(df.sparkSession)
    df.write.options(compression=compression, **options).parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most so many rows; stops reading beyond."""
    return df.limit(most + 1).count() <= most


def checked(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if it is small enough by rows and by the bytes of its strings and binaries; else as it is, for
    a join by shuffle. Other columns must be single numbers."""
    long = [F.coalesce(F.octet_length(F.col(f"`{c}`")).cast("long"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    n, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(sum(long, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key isn't in `gone`; rows with a null key stay."""
    return docs.join(checked(gone.select(key).distinct()), key, "left_anti").select(docs.columns)


def only(docs: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(checked(kept.select(key).distinct()), key, "left_semi").select(docs.columns)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, as they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        d = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, d, True)
        with zipfile.ZipFile(f"{d}/{top.name}.zip", "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(f"{d}/{top.name}.zip")
        _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with the package at hand on the executors."""
    ship(df.sparkSession)

    def whole(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Returns to the system what a finished task has freed, as workers live on and wait beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only in the GNU library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# words

def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per word; emptied when it has grown large, so memory stays bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self._most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


HASHES = WordHashes()


def word_hashes(found: list[bytes]) -> np.ndarray:
    """Functions sent to workers must call this, not HASHES: they take along a copy of what they name, and only a module's
    own functions find the dictionary that the worker keeps from task to task."""
    return HASHES.of(found)


_ODDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of each k consecutive words; of all words together if there are fewer; of none if there is none."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * _ODDS[0] + h[i : i + n] * _ODDS[1 + i % 5])
    return out


# Arrow


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with at most so many bytes of text each (or one row)."""
    for b in batches:
        lengths = np.array([x or 0 for x in pc.binary_length(b.column(column)).to_pylist()], np.int64) if b.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), most, "right")))
            yield b.slice(at, n)
            at += n


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the edges; root: the smallest node of its component.

    Alternating large-star and small-star rounds, all distributed, each round a table in the shared folder; a few rounds
    do, as their number goes with the logarithm of the size. The minimum of a node's neighbours is pre-aggregated on the
    map side and joined back, so that a hot node's edges may be split among tasks.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if state == last:
            break
        last = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
