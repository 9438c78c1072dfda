"""Byte-level BPE, encoding and decoding.

Bytes are read as Latin-1 text, so that one Aho-Corasick automaton over the vocabulary finds every token at every place.
From each place the longest token is tried first; two neighbours may stand side by side only if merging in rank order
would have left that boundary alone, which is decided from the tokens' own merge trees and remembered. A token that fits
nowhere gives way to its longest prefix, and a dead end is marked and stepped back from once, so that the time is linear.
The ids are those of merging by ranks. A vocabulary entry that merging never reaches takes part only as a whole piece.

Nulls count as empty text and give no ids. Rows pass one by one: repeated rows, extra columns and any lengths are as good
as others. Texts are cut at the spaces between words, where no piece of the pattern reaches across; cut-outs are
remembered in a dictionary of bounded size. A pattern that isn't known to allow such cuts is applied to whole texts.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, blocks, give_back, map_arrow

#: White space that isn't ASCII, or that ASCII rules don't count: before a cut it would change what the pattern takes.
_WIDE = [c.encode() for c in "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"]
_WIDE2 = np.array([int.from_bytes(w) for w in _WIDE if len(w) == 2], np.uint32)
_WIDE3 = np.array([int.from_bytes(w) for w in _WIDE if len(w) == 3], np.uint32)


_PUNCT = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
#: Patterns no piece of which goes on from what isn't white space to white space, or from a letter to a sign.
CUTTABLE = frozenset([r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""])


def cut_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where cut-outs begin in the bytes of texts laid end to end: at each text's start, at each ASCII white space behind
    something that isn't white space of any kind, and at each ASCII sign behind a letter (of ASCII or Latin-1)."""
    space = (data == 32) | (data - np.uint8(9) < 5)
    cut = np.zeros(len(data) + 1, bool)
    np.greater(space[1:], space[:-1], out=cut[1:-1])
    odd = np.flatnonzero(cut[1:-1] & ((data[:-1] >= 0x80) | (data[:-1] - np.uint8(0x1C) < 4))) + 1
    if len(odd):
        at = lambda back: data[np.maximum(odd - back, 0)].astype(np.uint32)
        two = at(2) << 8 | at(1)
        cut[odd] = ~((at(1) < 0x80) | np.isin(two, _WIDE2) | np.isin(at(3) << 16 | two, _WIDE3))
    sign = np.flatnonzero(_PUNCT[data[1:]]) + 1
    before, lead = data[sign - 1], data[np.maximum(sign - 2, 0)]
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    cut[sign[((before | 32) - np.uint8(97) < 26) | latin]] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def _pack(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Cuts(dict):
    """Encodes texts by cut-outs (white space and the word behind it, or signs), each looked up in this dictionary once per block.

    encode: the packed ids of one cut-out. Whether a pattern may be cut so is up to the caller: no piece of it may reach
    across the places of cut_starts, as is true of public_tokenizers.PATTERN.
    """

    def __init__(self, encode, most: int = 350_000):
        super().__init__()
        self._encode, self._most = encode, most

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin and the last one's end."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        if raw is None or not len(column) or offsets[0] == offsets[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
        base = int(offsets[0])
        data = np.frombuffer(raw, np.uint8)[base : offsets[-1]]
        starts = cut_starts(offsets - base, data)
        edges = pa.py_buffer(np.append(starts, len(data)) + base)
        found = pa.LargeStringArray.from_buffers(len(starts), edges, raw).dictionary_encode()
        keys = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        made = list(map(self.get, keys))
        missing = [i for i, m in enumerate(made) if m is None]
        if len(self) + len(missing) > self._most:
            self.clear()
        for i in missing:
            k = keys[i]
            made[i] = ids = self._encode(k)
            if len(k) <= 48 and len(self) < self._most:
                self[k] = ids
        taken = pa.array(made, pa.large_binary()).take(found.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        ids = np.frombuffer(taken.buffers()[2], "<u4", int(ends[-1]) // 4) if ends[-1] else np.zeros(0, "<u4")
        return ids, ends[np.searchsorted(starts, offsets - base)] // 4


class BytePairs:
    """encode() and decode() for one vocabulary: {token bytes: rank}, the ranks being the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = ranks
        self.split_text = regex.compile(pattern).findall
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        # From here on a token goes by its place in merge order, single bytes first.
        order = sorted(ranks, key=lambda t: (len(t) > 1, ranks[t]))
        self._at = {t: k for k, t in enumerate(order)}
        self._id = [ranks[t] for t in order]
        self._len = [len(t) for t in order]
        self._halves: list[tuple[int, int]] = []
        self._pair: dict[tuple[int, int], int] = {}
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._shorter: list[int] = []
        self._arrow: pa.Array | None = None
        self._auto = ahocorasick.Automaton()
        for k, t in enumerate(order):
            self._halves.append((k, k))
            for n in range(len(t) - 1, 0, -1):
                left, right = self._at.get(t[:n], k), self._at.get(t[n:], k)
                if left < k and right < k and self._reached(left) and self._reached(right) and self._beside(left, right):
                    self._halves[k], self._pair[left, right] = (left, right), k
                    break
        for k, t in enumerate(order):
            prefixes = (self._at[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self._at)
            self._shorter.append(next(filter(self._reached, prefixes), -1))
            if self._reached(k):
                self._auto.add_word(t.decode("latin-1"), k)
        self._auto.make_automaton()

    @classmethod
    def from_text(cls, text: bytes, pattern: str) -> BytePairs:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines()) if a}, pattern)

    def _reached(self, k: int) -> bool:
        return self._len[k] == 1 or self._halves[k][0] != k

    def _spine(self, k: int, side: int) -> list[tuple[int, int]]:
        """The parts of token k that reach its left (0) or right (1) end, each with the merge that takes it up."""
        out, until = [], len(self._id)
        while True:
            out.append((k, until))
            inner = self._halves[k][side]
            if inner == k:
                return out
            k, until = inner, k

    def _beside(self, a: int, b: int) -> bool:
        """Whether merging in order leaves the boundary between tokens a and b alone. A merge across it would join a part
        at a's right end and one at b's left end while neither has been taken up; of equal merges the left one comes first."""
        right = self._spine(b, 0)
        for x, until_x in self._spine(a, 1):
            for y, until_y in right:
                r = self._pair.get((x, y))
                if r is not None and r < until_x and r <= until_y:
                    return False
        return True

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        whole = self.ids.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [-1] * n
        lens, shorter, beside, known = self._len, self._shorter, self._beside, self._fits
        for end, k in self._auto.iter(raw.decode("latin-1")):
            longest[end - lens[k] + 1] = k  # ends rise, so the last one is the longest
        out: list[int] = []
        good, at, token = bytearray(b"\x01") * (n + 1), 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                if good[at + lens[token]]:
                    if last < 0:
                        break
                    key = last << 32 | token
                    fits = known.get(key)
                    if fits is None:
                        if len(known) >= 150_000:
                            known.clear()
                        fits = known[key] = beside(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lens[token]
                if at == n:
                    return [self._id[k] for k in out]
                token = longest[at]
            else:  # a dead end: the token before it gives way
                good[at] = 0
                token = out.pop()
                at -= lens[token]

    def packed(self, text: str) -> bytes:
        """Ids of any text, as little-endian unsigned 32-bit integers. Pieces of longer texts are remembered."""
        out, found = [], self.split_text(text)
        if len(found) == 1:
            return _pack(self.piece(found[0].encode("utf-8", "surrogatepass")))
        for p in found:
            ids = self._pieces.get(p)
            if ids is None:
                ids = _pack(self.piece(p.encode("utf-8", "surrogatepass")))
                if len(p) <= 48:
                    if len(self._pieces) >= 200_000:
                        self._pieces.clear()
                    self._pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As Cuts.texts, without cuts: for any pattern."""
        made = [np.frombuffer(self.packed(t or ""), "<u4") for t in column.to_pylist()]
        return np.concatenate([np.zeros(0, "<u4"), *made]), np.concatenate(([0], np.cumsum([len(m) for m in made], dtype=np.int64)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each stretch of ids between two ends."""
        if self._arrow is None:
            self._arrow = pa.array(self.tokens, pa.large_binary())
        taken = self._arrow.take(pa.array(ids))
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(ids) else np.zeros(1, np.int64)
        return stretches(taken.buffers()[2], at[ends])


def stretches(raw, ends: np.ndarray) -> pa.Array:
    """A binary column of the stretches of a buffer between ends."""
    ends = np.ascontiguousarray(ends, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), raw if raw is not None else pa.py_buffer(b"")]).cast(pa.binary())


#: Bytes of text that are encoded at once.
BLOCK = 1 << 20

_READY: dict[tuple, tuple[BytePairs, Cuts]] = {}


def _ready(vocabulary: bytes, pattern: str) -> tuple[BytePairs, Cuts]:
    """Built once per worker process; what other operators remembered in it goes, as workers are used again."""
    HASHES.clear()
    key = hash(vocabulary), pattern
    if key not in _READY:
        give_back()
        b = BytePairs.from_text(vocabulary, pattern)
        _READY[key] = b, Cuts(b.packed, 200_000)
    return _READY[key]


def coded(batches: Iterable[pa.RecordBatch], vocabulary: bytes, pattern: str, text: str, rest: list[str], *, decode: bool = True) -> Iterator[list[pa.Array]]:
    """The columns of `rest`, the ids of the text column and the bytes decoded from them. A worker's memory is that of its
    dictionaries and some twenty times BLOCK, besides the batch: small blocks, as several workers share an executor."""
    pairs, cuts = _ready(vocabulary, pattern)
    for b in blocks(batches, text, BLOCK):
        ids, ends = cuts.texts(b.column(text)) if pattern in CUTTABLE else pairs.texts(b.column(text))
        yield [*(b.column(c) for c in rest), stretches(pa.py_buffer(ids), 4 * ends), *([pairs.decoded(ids, ends)] if decode else [])]


def encode_and_decode(docs: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", decode: bool = True) -> DataFrame:
    """Replaces the text column by ids (binary, little-endian unsigned 32-bit) and decoded (binary, from those ids).

    vocabulary: a local file of the driver with lines of base64 token and rank; its bytes (under 1 MB) go to the executors.
    """
    rest = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    shape = docs.select(*rest, F.lit(b"").alias("ids"), *([F.lit(b"").alias("decoded")] if decode else [])).schema
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in coded(batches, sent.value, pattern, text, rest, decode=decode):
            yield pa.RecordBatch.from_arrays(made, names=shape.names)

    return map_arrow(docs.select(*rest, text), run, shape)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of ids and of decoded bytes."""
    made = encode_and_decode(docs.select("doc_id", "text"), vocabulary, pattern)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
