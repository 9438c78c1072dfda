"""Removal of repeated passages: words in a window of 20 whose words also start earlier are taken out.

First pass. The five-word hash that is the least of a window's sixteen is the window's anchor; equal windows have equal
anchors at equal offsets, and neighbouring windows mostly share one, so that only about every eighth word is one. Each
task counts its anchors in a sparse count-min sketch; sketches are merged cell range by cell range, and a bit for each
cell says whether it was met twice. A window's count is never above its anchor's estimate, so none that repeats is lost.

Second pass. Windows whose anchor was met twice in both rows of the sketch are grouped exactly, by 128 bits of hash. A
task first settles what repeats within it and sends on one row a key; so a passage that stands in a third of all
documents sends one row per task. The first start by (doc_id, place) of each group stays; the others' words go.
Documents with the same words as an earlier one go as a whole without taking part.

The sketch grows with the corpus, eight cells for each likely anchor. Its merged bits are broadcast if they take no more
than broadcast_bytes, or can be folded to that (neighbouring cells as one) with at most PASSED of the unique windows let
through; few cells are met twice, so that folding by eight mostly does little harm. Beyond that they stay dealt by cell
range, and are asked by a join: a task sends each range the anchors that it wants to know of, those of all its documents in
one message, and gets back which of them were met twice. Neither way holds more than one range or the bound in a task.

Nulls are texts without words. Documents with fewer than 20 words lose nothing. Other columns are left out. Documents
without doc_id come first in order; those that share one (or have none) are told apart, and stand in order of their
text's hash, then of their text. Each row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, blocks, checked, map_arrow, mix, shingle_hashes, without, word_hashes, written

ROWS = 2
SEGMENT_BITS = 22
#: Folding may let through so many of the unique windows; they cost time, not results.
PASSED = 0.05
_SEEDS = [np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)]
_INNER = 5


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of five words at each place, and for each window the place of its anchor (the first of the least)."""
    m = shingle_hashes(h, _INNER)
    width = window - _INNER + 1
    n = len(h) - window + 1
    step, out = 1 << 22, []
    for at in range(0, n, step):
        some = m[at : min(at + step, n) + width - 1]
        key = (some & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(some), dtype=np.uint64)
        have = 1
        while have < width:  # the least of `have` places grows to the least of `width`
            by = min(have, width - have)
            key = np.minimum(key[:-by], key[by:])
            have += by
        out.append((key & np.uint64(0xFFFFFF)).astype(np.int64) + at)
    return m, np.concatenate(out)


def window_keys(h: np.ndarray, m: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each of the windows that start at `at`."""
    other = shingle_hashes(h ^ np.uint64(0xA4093822299F31D0), _INNER)
    places = [*range(0, window - _INNER, _INNER), window - _INNER]
    out = []
    for source, seed in ((m, np.uint64(1)), (other, np.uint64(2))):
        k = np.full(len(at), seed, np.uint64)
        for p in places:
            k = mix(k * np.uint64(0x9E3779B97F4A7C15) + source[at + p])
        out.append(k)
    return out[0], out[1]


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(values ^ _SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


_FIRST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("cell_row", pa.int32()), ("segment", pa.int32()), ("counts", pa.binary())])


def _first_pass(docs: DataFrame, bits: int, window: int) -> DataFrame:
    """Rows of two kinds: a document's number of words and hash of its words; a task's counts for one cell range."""
    width = max(0, bits - SEGMENT_BITS)

    def sketch(values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        flat = np.concatenate(values)
        for row in range(ROWS):
            cell, n = np.unique(cells(flat, row, bits), return_counts=True)
            segment = cell >> SEGMENT_BITS
            marks = np.flatnonzero(np.diff(segment, prepend=-1))
            for a, e in zip(marks.tolist(), [*marks[1:].tolist(), len(cell)], strict=True):
                local = (cell[a:e] & ((1 << SEGMENT_BITS) - 1)).astype(np.uint32)
                packed = z.compress(np.diff(local, prepend=np.uint32(0)).astype("<u4").tobytes() + np.minimum(n[a:e], 2).astype(np.uint8).tobytes())
                yield batch(_FIRST, [[None], [None], [None], [None], [row], [int(segment[a])], [packed]])

    def run(batches):
        held, size = [], 0
        for b in blocks(batches, "text"):
            n, hashes = [], []
            for t in b.column("text").to_pylist():
                found = split_words(t)
                n.append(len(found))
                hashes.append(xxhash.xxh3_128_digest(b" ".join(found)))
                if len(found) >= window:
                    m, at = anchors(word_hashes(found), window)
                    held.append(m[at[np.flatnonzero(np.diff(at, prepend=-1))]])
                    size += len(held[-1])
            none = [None] * len(n)
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield batch(_FIRST, [b.column("doc_id"), n, h[:, 0], h[:, 1], none, none, none])
            if size > 4_000_000:
                yield from sketch(held)
                held, size = [], 0
        if held:
            yield from sketch(held)

    return map_arrow(docs, run, "doc_id long, n_words long, h1 long, h2 long, cell_row int, segment int, counts binary")


def _merged(parts: DataFrame, bits: int) -> DataFrame:
    """The sketches added up, each cell range by one task: (cell_row, segment, twice, n_twice), a compressed bit for each cell and how many are set."""
    size = 1 << min(bits, SEGMENT_BITS)
    shape = pa.schema([("cell_row", pa.int32()), ("segment", pa.int32()), ("twice", pa.binary()), ("n_twice", pa.int64())])

    def run(batches):
        z, unzip = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        now, counts = None, None
        for b in batches:
            for row, segment, packed in zip(*(b.column(c).to_pylist() for c in ("cell_row", "segment", "counts")), strict=True):
                if now != (row, segment):
                    if now:
                        yield batch(shape, [[now[0]], [now[1]], [z.compress(np.packbits(counts >= 2).tobytes())], [int((counts >= 2).sum())]])
                    now, counts = (row, segment), np.zeros(size, np.uint8)
                raw = unzip.decompress(packed)
                n = len(raw) // 5
                at = np.cumsum(np.frombuffer(raw[: 4 * n], "<u4"))
                counts[at] = np.minimum(counts[at] + np.frombuffer(raw[4 * n :], np.uint8), 2)
        if now:
            yield batch(shape, [[now[0]], [now[1]], [z.compress(np.packbits(counts >= 2).tobytes())], [int((counts >= 2).sum())]])

    dealt = parts.repartition("cell_row", "segment").sortWithinPartitions("cell_row", "segment")
    return map_arrow(dealt, run, "cell_row int, segment int, twice binary, n_twice long")


def _folds(twice: DataFrame, bits: int, most_bytes: int) -> int | None:
    """How often the bits must be halved to be broadcast; None if too many unique windows would pass then."""
    by = 0
    while by < min(bits, SEGMENT_BITS) - 3 and ROWS * (1 << (bits - by)) // 8 > most_bytes:
        by += 1
    if ROWS * (1 << (bits - by)) // 8 > most_bytes:
        return None
    shares = [1 - (1 - r.n / (1 << bits)) ** (1 << by) for r in twice.groupBy("cell_row").agg(F.sum("n_twice").alias("n")).collect()]
    return by if not by or np.prod(shares) <= PASSED else None


def _folded(twice: DataFrame, by: int) -> DataFrame:
    """The merged bits with each 2**by neighbouring cells as one."""
    shape = pa.schema([("cell_row", pa.int32()), ("segment", pa.int32()), ("twice", pa.binary())])

    def run(batches):
        z, unzip = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for b in batches:
            for row, segment, packed in zip(*(b.column(c).to_pylist() for c in ("cell_row", "segment", "twice")), strict=True):
                marks = np.unpackbits(np.frombuffer(unzip.decompress(packed), np.uint8))
                yield batch(shape, [[row], [segment], [z.compress(np.packbits(marks.reshape(-1, 1 << by).any(1)).tobytes())]])

    return map_arrow(twice.select("cell_row", "segment", "twice"), run, "cell_row int, segment int, twice binary") if by else twice


# a sketch that is too large to be broadcast

_ASKED = pa.schema([("segment", pa.int32()), ("docs", pa.binary()), ("data", pa.binary())])
_KNOWN = -1


def _packed(segment: int, docs: np.ndarray, values: np.ndarray) -> tuple[int, bytes, bytes]:
    return segment, np.diff(docs, prepend=np.int64(0)).astype("<i8").tobytes(), values.astype("<u8").tobytes()


def _unpacked(docs: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(docs, "<i8")), np.frombuffer(data, "<u8")


def _by_segment(docs: np.ndarray, values: np.ndarray, row: int, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Anchors and their documents, packed for each cell range of a sketch's row; after the last row as known."""
    if row == ROWS:
        for i in range(0, len(values), 500_000):
            yield _packed(_KNOWN, docs[i : i + 500_000], values[i : i + 500_000])
        return
    segment = cells(values, row, bits) >> SEGMENT_BITS
    order = np.argsort(segment, kind="stable")
    marks = np.flatnonzero(np.diff(segment[order], prepend=-1))
    for a, e in zip(marks.tolist(), [*marks[1:].tolist(), len(values)], strict=True):
        yield _packed(int(segment[order[a]]), docs[order[a:e]], values[order[a:e]])


def _messages(packed: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of some 4 MB."""
    out, size = [], 0
    for one in packed:
        out.append(one)
        size += len(one[1]) + len(one[2])
        if size > 4 << 20:
            yield batch(_ASKED, [list(c) for c in zip(*out, strict=True)])
            out, size = [], 0
    if out:
        yield batch(_ASKED, [list(c) for c in zip(*out, strict=True)])


def _asked(docs: DataFrame, bits: int, window: int) -> DataFrame:
    """(segment, docs, data): a task's anchors with their documents, those that it meets twice itself as known (so that one
    of which a third of all documents has is answered at once), the others by the cell range of the sketch's first row."""

    def told(ids: list[int], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, doc = np.concatenate(held), np.repeat(np.array(ids, np.int64), [len(x) for x in held])
        _, place, n = np.unique(values, return_inverse=True, return_counts=True)
        often = n[place] > 1
        yield from _messages(_by_segment(doc[often], values[often], ROWS, bits))
        yield from _messages(_by_segment(doc[~often], values[~often], 0, bits))

    def run(batches):
        ids, held, size = [], [], 0
        for b in blocks(batches, "text"):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = split_words(t)
                if len(found) >= window:
                    m, at = anchors(word_hashes(found), window)
                    ids.append(i)
                    held.append(m[at[np.flatnonzero(np.diff(at, prepend=-1))]])
                    size += len(held[-1])
                if size > 2_000_000:
                    yield from told(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield from told(ids, held)

    return map_arrow(docs, run, "segment int, docs binary, data binary")


def _answered(asked: DataFrame, twice: DataFrame, row: int, bits: int) -> DataFrame:
    """Of the anchors asked those whose cell was met twice in this row, by the next row's cell range or, after the last, as known."""

    def run(batches):
        now, marks, held, size = None, None, ([], []), 0
        for big in batches:
            for b in blocks([big], "data"):
                for segment, docs, data in zip(*(b.column(c).to_pylist() for c in ("segment", "docs", "data")), strict=True):
                    if docs is None:
                        now, marks = segment, np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
                    elif now == segment:
                        doc, values = _unpacked(docs, data)
                        c = cells(values, row, bits) & ((1 << SEGMENT_BITS) - 1)
                        yes = (marks[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                        held[0].append(doc[yes])
                        held[1].append(values[yes])
                        size += len(held[0][-1])
                    if size > 2_000_000:
                        yield from _messages(_by_segment(*map(np.concatenate, held), row + 1, bits))
                        held, size = ([], []), 0
        if size:
            yield from _messages(_by_segment(*map(np.concatenate, held), row + 1, bits))

    bit_rows = twice.where(F.col("cell_row") == row).select("segment", F.lit(None).cast("binary").alias("docs"), F.col("twice").alias("data"))
    dealt = bit_rows.unionByName(asked).repartition("segment").sortWithinPartitions("segment", F.col("docs").isNotNull())
    return map_arrow(dealt, run, "segment int, docs binary, data binary")


def _by_document(known: DataFrame) -> DataFrame:
    """(doc_id, data): of each message a row for each document, with its anchors."""
    shape = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for big in batches:
            for b in blocks([big], "data"):
                for docs, data in zip(*(b.column(c).to_pylist() for c in ("docs", "data")), strict=True):
                    doc, values = _unpacked(docs, data)
                    order = np.argsort(doc, kind="stable")
                    doc, values = doc[order], values[order]
                    marks = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                    ends = (np.append(marks, len(doc)) * 8).astype("<i4")
                    column = pa.Array.from_buffers(pa.binary(), len(marks), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])
                    yield batch(shape, [doc[marks], column])

    return map_arrow(known.select("docs", "data"), run, "doc_id long, data binary")


def _known(docs: DataFrame, twice: DataFrame, bits: int, window: int) -> DataFrame:
    """(doc_id, known): of each document the anchors that were met twice in all rows of the sketch, as the join finds them."""
    asked = written(_asked(docs, bits, window))
    found, left = asked.where(F.col("segment") == _KNOWN), asked.where(F.col("segment") != _KNOWN)
    for row in range(ROWS):
        left = _answered(left, twice, row, bits)
    return _by_document(found.unionByName(left)).groupBy("doc_id").agg(F.collect_list("data").alias("known"))  # a document's own anchors


class Sketch:
    """The merged bits, unpacked once per worker process."""

    _last: tuple | None = None

    def __init__(self, bits: int, twice: dict[tuple[int, int], bytes]):
        self.bits, self.rows = bits, []
        for row in range(ROWS):
            out = np.zeros((1 << bits) // 8, np.uint8)
            for (r, s), packed in twice.items():
                if r == row:
                    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
                    out[s * len(raw) : (s + 1) * len(raw)] = raw
            self.rows.append(out)

    def repeated(self, values: np.ndarray) -> np.ndarray:
        yes = np.ones(len(values), bool)
        for row, bits in enumerate(self.rows):
            c = cells(values, row, self.bits)
            yes &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return yes


_SECOND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("run", pa.int64())])


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of a document as (doc, start, length)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(at) != 1)))) if len(doc) else np.zeros(0, int)
    return doc[new], at[new], np.diff(np.append(new, len(doc)))


def _second_pass(docs: DataFrame, sent, bits: int, window: int) -> DataFrame:
    """sent: the merged bits; None if documents come with the anchors that are known to be met twice. Candidate windows: of each key a task's first (run 0), and the others, known to repeat, as runs of starts."""

    def settle(k1, k2, doc, at) -> Iterator[pa.RecordBatch]:
        k1, k2, doc, at = map(np.concatenate, (k1, k2, doc, at))
        order = np.lexsort((at, doc, k2, k1))
        a, b = k1[order], k2[order]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        one, more = order[first], order[~first]
        d, s, n = _runs(doc[more], at[more])
        for cols in ((k1[one].view(np.int64), k2[one].view(np.int64), doc[one], at[one], np.zeros(len(one), np.int64)), (mix(d.view(np.uint64)).view(np.int64), s, d, s, n)):
            for i in range(0, len(cols[0]), 200_000):
                yield batch(_SECOND, [c[i : i + 200_000] for c in cols])

    def run(batches):
        if sent is not None and (Sketch._last is None or Sketch._last[0] != id(sent.value)):
            Sketch._last = id(sent.value), Sketch(bits, sent.value)
        sketch = Sketch._last[1] if sent is not None else None
        held, size = ([], [], [], []), 0
        for b in blocks(batches, "text"):
            known = b.column("known").to_pylist() if sketch is None else [()] * b.num_rows
            for i, t, own in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), known, strict=True):
                found = split_words(t)
                if len(found) < window:
                    continue
                h = word_hashes(found)
                m, at = anchors(h, window)
                marks = np.flatnonzero(np.diff(at, prepend=-1))
                met = np.isin(m[at[marks]], np.frombuffer(b"".join(own), "<u8")) if sketch is None else sketch.repeated(m[at[marks]])
                yes = np.repeat(met, np.diff(np.append(marks, len(at))))
                some = np.flatnonzero(yes)
                if len(some):
                    k1, k2 = window_keys(h, m, some, window)
                    for x, y in zip(held, (k1, k2, np.full(len(some), i, np.int64), some.astype(np.int64)), strict=True):
                        x.append(y)
                    size += len(some)
            if size > 2_000_000:
                yield from settle(*held)
                held, size = ([], [], [], []), 0
        if size:
            yield from settle(*held)

    return map_arrow(docs, run, "k1 long, k2 long, doc_id long, start long, run long")


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """docs: own (the document's id), text, starts and runs of windows that go. The words that stay, joined by blanks."""
    shape = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for b in blocks(batches, "text"):
            n, removed, kept = [], [], []
            starts, runs = b.column("starts").to_pylist(), b.column("runs").to_pylist()
            for t, at, length in zip(b.column("text").to_pylist(), starts, runs, strict=True):
                found = split_words(t)
                n.append(len(found))
                if at:
                    edge = np.zeros(len(found) + 1, np.int64)
                    at = np.array(at, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.maximum(np.array(length, np.int64), 1) - 1 + window, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    found = [w for w, s in zip(found, stays.tolist(), strict=True) if s]
                removed.append(n[-1] - len(found))
                kept.append(b" ".join(found))
            yield batch(shape, [b.column("own"), n, removed, kept])

    return map_arrow(docs, run, "doc_id long, n_words long, n_removed long, kept binary")


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text): own is the document's id; doc_id the same or, if ids repeat or are null, a number in their order."""
    docs = docs.select(F.col("doc_id").cast("long").alias("own"), "text")
    if not docs.groupBy("own").count().where("count > 1 or own is null").head(1):
        return docs.select(F.col("own").alias("doc_id"), "own", "text")
    by = [F.col("own").asc_nulls_first(), F.xxhash64("text"), F.col("text"), F.col("_row")]  # the last one splits equal rows
    dealt = docs.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by[:2], by[3]).sortWithinPartitions(*by)
    return written(dealt.select(F.monotonically_increasing_id().alias("doc_id"), "own", "text"))


def deduplicated(docs: DataFrame, *, window: int = 20, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 bytes of the words that stay)."""
    docs = _numbered(docs)
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 10
    while (1 << bits) < n // 6:  # eight cells for each anchor that is likely
        bits += 1
    first = written(_first_pass(docs.select("doc_id", "text"), bits, window))
    heads = first.where("n_words is not null").select("doc_id", "n_words", "h1", "h2")
    twice = written(_merged(first.where("segment is not null").select("cell_row", "segment", "counts"), bits))

    reps = heads.where(f"n_words >= {window}").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = written(heads.join(checked(written(reps.drop("n"))), ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "n_words"))

    rest = without(docs.select("doc_id", "text"), copies)
    by = _folds(twice, bits, broadcast_bytes)
    if by is not None:
        sent = docs.sparkSession.sparkContext.broadcast({(r.cell_row, r.segment): bytes(r.twice) for r in _folded(twice, by).toLocalIterator()})
        found = _second_pass(rest, sent, bits - by, window)
    else:
        known = _known(rest, twice, bits, window)
        found = _second_pass(rest.join(known, "doc_id"), None, bits, window)
    group = Window.partitionBy("k1", "k2")  # a row per task and key at most: pre-aggregated above
    later = found.withColumn("_first", F.min(F.struct("doc_id", "start")).over(group.orderBy("doc_id", "start")))
    gone = later.where("run > 0 or _first.doc_id <> doc_id or _first.start <> start").select("doc_id", F.col("start").cast("int"), F.col("run").cast("int"))
    gone = gone.unionByName(copies.select("doc_id", F.lit(0).alias("start"), (F.col("n_words") - window + 1).cast("int").alias("run")))
    lists = gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "run")).alias("g")).select("doc_id", F.col("g.start").alias("starts"), F.col("g.run").alias("runs"))
    return _kept(docs.join(lists, "doc_id", "left").select("own", "text", "starts", "runs"), window)


def digests(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 x AS (SELECT doc_id, ws, len(ws) AS n FROM w),
 p AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, n - 18)) AS i FROM x WHERE n >= 20)),
 d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM p) WHERE r > 1),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM d),
 e AS (SELECT x.doc_id, u.j, x.ws[u.j] AS word, c.j IS NOT NULL AS gone FROM x, unnest(range(1, x.n + 1)) AS u(j) LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = u.j)
SELECT x.doc_id, CAST(x.n AS BIGINT) AS n_words, CAST(coalesce(g.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM x LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS gone, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY 1) g ON g.doc_id = x.doc_id
"""
