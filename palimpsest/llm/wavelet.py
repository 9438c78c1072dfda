"""Token ids in wavelet-matrix files.

A shard holds some consecutive documents (ascending doc_id). Its distinct ids get dense codes; bit-plane b keeps bit b of
every code, after stably moving codes with a zero in the plane above before those with a one. With ranks kept every 512
bits, the planes alone answer: which id stands at a place, how often an id occurs in a stretch, and where its k-th
occurrence is. A shard is one compressed file: each plane is cut into frames of 16 KB that are compressed by themselves, so
that a query unpacks only those frames that it looks into, one or two for a plane. Spark's commit writes the files: each is
the one row of its own Parquet file, so that a lost task's are left out and any file system will do.

Documents come in doc_id order, nulls first; texts that are null count as empty; each document is followed by the end id.
Repeated doc_ids keep all their rows, ordered by text. Other columns are left out.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CUTTABLE, Cuts, _pack
from .common import batch, blocks, checked, map_arrow, written

MAGIC = b"WMT2"
_RANK_EVERY = 512
_FRAME = 1 << 14  # bytes


def _ranks(p: np.ndarray) -> np.ndarray:
    """The number of ones before every 512th bit."""
    ones = np.bitwise_count(np.pad(p, (0, -len(p) % 64)).view("<u8")).reshape(-1, 8).sum(1) if len(p) else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.cumsum(ones)))[: max(1, len(ones))].astype(np.uint32)


class WaveletMatrix:
    """Built from ids, or read from bytes. Places are 0-based, stretches half-open."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list, zeros: list[int], docs: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ranks: list[np.ndarray] | None = None):
        self.n, self.alphabet, self._planes, self.zeros = n, alphabet, planes, zeros
        self.docs, self.nulls, self.lengths = docs, nulls, lengths
        self._ranks = [_ranks(p) for p in planes] if ranks is None else ranks
        self.frames: dict[tuple[int, int], np.ndarray] = {}

    # building

    @classmethod
    def build(cls, ids: np.ndarray, docs: list[int | None] = (), lengths: list[int] = ()) -> WaveletMatrix:
        top = int(ids.max()) + 1 if len(ids) else 0
        seen = np.bincount(ids, minlength=top) if top <= 1 << 22 else None
        alphabet = (np.flatnonzero(seen) if seen is not None else np.unique(ids)).astype(np.uint32)
        if seen is not None:
            place = np.zeros(max(top, 1), np.uint32)
            place[alphabet] = np.arange(len(alphabet))
            cur = place[ids]
        else:
            cur = np.searchsorted(alphabet, ids)
        bits = max(1, (max(len(alphabet), 1) - 1).bit_length())
        cur = cur.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (cur & cur.dtype.type(1 << b)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            low = cur[~one]
            zeros.append(len(low))
            cur = np.concatenate((low, cur[one]))
        return cls(len(ids), alphabet, planes, zeros, np.array([x or 0 for x in docs], np.int64), np.array([x is None for x in docs], bool), np.array(lengths, np.uint32))

    # the file

    def to_bytes(self) -> bytes:
        z = zstandard.ZstdCompressor(level=1)
        parts = [self.alphabet.astype("<u4").tobytes(), self.docs.astype("<i8").tobytes(), np.packbits(self.nulls).tobytes(), self.lengths.astype("<u4").tobytes()]
        parts += [ranks.astype("<u4").tobytes() for ranks in self._ranks]
        for bits in self._planes:
            raw = bits.tobytes()
            parts += [raw[at : at + _FRAME] for at in range(0, max(len(raw), 1), _FRAME)]
        packed = [z.compress(p) for p in parts]
        head = struct.pack("<4sQIIII", MAGIC, self.n, len(self.alphabet), len(self.docs), len(self._planes), len(packed))
        head += struct.pack(f"<{len(self.zeros)}Q", *self.zeros) + struct.pack(f"<{len(packed)}I", *map(len, packed))
        return head + struct.pack("<I", zlib.crc32(head)) + b"".join(packed)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        magic, n, _, n_docs, n_planes, n_parts = struct.unpack_from("<4sQIIII", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet file")
        at = struct.calcsize("<4sQIIII")
        zeros = list(struct.unpack_from(f"<{n_planes}Q", raw, at))
        at += 8 * n_planes
        sizes = struct.unpack_from(f"<{n_parts}I", raw, at)
        at += 4 * n_parts
        if struct.unpack_from("<I", raw, at)[0] != zlib.crc32(raw[:at]):
            raise ValueError("the file's head is damaged")
        ends = np.cumsum([at + 4, *sizes])
        parts = [memoryview(raw)[a:e] for a, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        unzip = zstandard.ZstdDecompressor().decompress
        docs = np.frombuffer(unzip(parts[1]), "<i8")
        each = (n_parts - 4 - n_planes) // max(n_planes, 1)
        planes = [parts[4 + n_planes + i * each : 4 + n_planes + (i + 1) * each] for i in range(n_planes)]
        ranks = [np.frombuffer(unzip(parts[4 + i]), "<u4") for i in range(n_planes)]
        return cls(n, np.frombuffer(unzip(parts[0]), "<u4"), planes, zeros, docs, np.unpackbits(np.frombuffer(unzip(parts[2]), np.uint8))[:n_docs].astype(bool), np.frombuffer(unzip(parts[3]), "<u4"), ranks)

    def plane(self, i: int) -> np.ndarray:
        """All packed bits of plane i."""
        p = self._planes[i]
        if not isinstance(p, list):
            return p
        unzip = zstandard.ZstdDecompressor().decompress
        return np.frombuffer(b"".join(map(unzip, p)), np.uint8)

    def frame(self, i: int, f: int) -> np.ndarray:
        """The packed bits of frame f of plane i. Of a file's frames the last asked for are kept."""
        if not isinstance(self._planes[i], list):
            return self._planes[i][f * _FRAME : (f + 1) * _FRAME]
        if (i, f) not in self.frames:
            if len(self.frames) >= 256:
                self.frames.clear()
            self.frames[i, f] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._planes[i][f]), np.uint8)
        return self.frames[i, f]

    # queries

    def _ones(self, i: int, at: int) -> int:
        """Ones of plane i before place `at`."""
        ranks = self._ranks[i]
        block = min(at // _RANK_EVERY, len(ranks) - 1)
        f = block * 64 // _FRAME
        rest = self.frame(i, f)[block * 64 - f * _FRAME : (at + 7) // 8 - f * _FRAME]
        n = int(ranks[block]) + int(np.bitwise_count(rest).sum())
        return n - int(rest[-1] >> (at % 8)).bit_count() if at % 8 and len(rest) else n

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        code = 0
        for i, z in enumerate(self.zeros):
            bit = int(self.frame(i, (at >> 3) // _FRAME)[(at >> 3) % _FRAME]) >> (at & 7) & 1
            ones = self._ones(i, at)
            at = z + ones if bit else at - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _stretch(self, code: int, low: int, high: int) -> tuple[int, int]:
        top = len(self.zeros) - 1
        for i, z in enumerate(self.zeros):
            a, b = self._ones(i, low), self._ones(i, high)
            low, high = (z + a, z + b) if code >> (top - i) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id in [low, high)."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._stretch(code, low, self.n if high is None else high)
        return b - a

    def rank(self, token: int, at: int) -> int:
        return self.count(token, 0, at)

    def _select_bit(self, i: int, one: bool, k: int) -> int:
        """The place of the k-th (from 0) one or zero of plane i, by bisecting ranks."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(i, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        code = self._code(token)
        if code is None or not 0 <= k < self.count(token):
            raise IndexError((token, k))
        at, _ = self._stretch(code, 0, self.n)
        at += k
        for i in range(len(self.zeros) - 1, -1, -1):
            one = at >= self.zeros[i]
            at = self._select_bit(i, one, at - self.zeros[i] if one else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """Every id in order, plane by plane from the last."""
        vals = None
        for i in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.plane(i), count=self.n, bitorder="little").view(bool)
            b = len(self.zeros) - 1 - i
            if vals is None:
                vals = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
            else:
                up = np.empty_like(vals)
                z = self.zeros[i]
                up[~one], up[one] = vals[:z], vals[z:]
                vals = up
            vals |= one.astype(vals.dtype) << vals.dtype.type(b)
        return self.alphabet[vals] if vals is not None and self.n else np.zeros(0, np.uint32)


# encoding by the library


def _letters() -> dict[int, str]:
    """The library's printable stand-ins for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryEncoder:
    """Ids by the tokenizers library, as packed little-endian unsigned 32-bit integers.

    A text with a special token's string goes to the library whole, as do all if the pattern (that of the description's own
    splitter) isn't known to allow cuts; others by cut-outs that are remembered.
    """

    def __init__(self, description: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_str(description)
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._split, self._model, self._letters = regex.compile(pattern).findall, self._tok.model, _letters()
        self._pieces: dict[str, bytes] = {}
        self._cuts, self._cuttable = Cuts(self._cut, 1_000_000), pattern in CUTTABLE

    def _piece(self, p: str) -> bytes:
        if p.isascii() and p.lstrip(" ").isalpha():
            p = p.replace(" ", "\u0120")
        else:
            p = p.encode().decode("latin-1").translate(self._letters)
        return _pack([t.id for t in self._model.tokenize(p)])

    def _cut(self, text: str) -> bytes:
        if text.isalpha() or text[0] == " " and text[1:].isalpha():  # one piece
            return self._piece(text)
        out = []
        for p in self._split(text):
            ids = self._pieces.get(p)
            if ids is None:
                ids = self._piece(p)
                if len(p) <= 48:
                    if len(self._pieces) >= 100_000:
                        self._pieces.clear()
                    self._pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin and the last one's end."""
        column = pc.fill_null(column, "")
        marked = np.zeros(len(column), bool)
        for s in self._special:
            marked |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        if self._cuttable and not marked.any():
            return self._cuts.texts(column)
        made = []
        for t, m in zip(column.to_pylist(), marked.tolist(), strict=True):
            if m or not self._cuttable:
                made.append(np.array(self._tok.encode(t, add_special_tokens=False).ids, "<u4"))
            else:
                made.append(self._cuts.texts(pa.array([t]))[0])
        return np.concatenate([np.zeros(0, "<u4"), *made]), np.concatenate(([0], np.cumsum([len(m) for m in made], dtype=np.int64)))


_READY: dict[tuple, LibraryEncoder] = {}


def _ready(description: str, pattern: str) -> LibraryEncoder:
    """Built once per worker process. (A function that is sent to workers would take along a copy of _READY itself.)"""
    key = hash(description), pattern
    if key not in _READY:
        _READY[key] = LibraryEncoder(description, pattern)
    return _READY[key]



SHARDS = "part int, shard int, n_tokens long, file binary"
READ = "part int, shard int, place int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, description: str, pattern: str, *, end_id: int = 0, shard_tokens: int = 1 << 21) -> DataFrame:
    """Encodes (doc_id, text) in doc_id order into shards of about so many tokens, one row (part, shard, n_tokens, file) each.

    The range exchange deals texts, not ids, as its sampling would else encode everything twice. description: a local
    file of the driver.
    """
    spark = docs.sparkSession
    parts = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 1)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    sent = spark.sparkContext.broadcast(Path(description).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = _ready(sent.value, pattern), TaskContext.get().partitionId(), 0
        shape = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("file", pa.binary())])
        docs, sizes, packed, held = [], [], [], 0

        def shut():
            ids = np.concatenate(packed)
            made = WaveletMatrix.build(ids, docs, np.concatenate(sizes))
            return batch(shape, [[part], [shard], [len(ids)], [made.to_bytes()]])

        for b in blocks(batches, "text", 16 << 20):
            ids, ends = encoder.texts(b.column("text"))
            ids, ends, names = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends)), b.column("doc_id").to_pylist()
            at = 0
            while at < len(names):  # whole texts, up to the first with which the shard is full
                to = min(len(names), int(np.searchsorted(ends, ends[at] + shard_tokens - held, "left")))
                docs += names[at:to]
                sizes.append(np.diff(ends[at : to + 1]))
                packed.append(ids[ends[at] : ends[to]])
                held += len(packed[-1])
                at = to
                if held >= shard_tokens:
                    yield shut()
                    docs, sizes, packed, held, shard = [], [], [], 0, shard + 1
        if docs:
            yield shut()

    return written(map_arrow(dealt, run, SHARDS), compression="none", maxRecordsPerFile="1")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files alone: place in its shard, first token's place there, number of tokens, CRC-32 of the ids."""
    shape = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, raw in zip(b.column("part").to_pylist(), b.column("shard").to_pylist(), b.column("file"), strict=True):
                m = WaveletMatrix.from_bytes(raw.as_buffer().to_pybytes())
                ids = memoryview(m.all().astype("<u4").tobytes())
                ends = np.cumsum(m.lengths, dtype=np.int64)
                starts = ends - m.lengths
                n = len(ends)
                crc = [zlib.crc32(ids[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield batch(shape, [np.full(n, part, np.int32), np.full(n, shard, np.int32), np.arange(n, dtype=np.int32), pa.array(m.docs, pa.int64(), mask=m.nulls), starts, m.lengths.astype(np.int64), np.array(crc, np.int64)])

    return map_arrow(shards.select("part", "shard", "file"), run, READ)


def with_starts(per_doc: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds start: ids of all documents before. Sums of shards run within their part, sums of parts over the parts (as many as tasks)."""
    sizes = shards.select("part", "shard", "n_tokens")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    parts = parts.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    base = sizes.select("part", "shard", before.alias("shard_start")).join(parts, "part").select("part", "shard", (F.col("shard_start") + F.col("part_start")).alias("base"))
    return per_doc.join(checked(base), ["part", "shard"]).withColumn("start", F.col("base") + F.col("local_start"))


def write_and_read(docs: DataFrame, description: str, pattern: str) -> DataFrame:
    shards = write_shards(docs, description, pattern)
    return with_starts(read_shards(shards), shards).select("doc_id", "start", "n_tokens", "ids_crc32")
