"""A bigram language model in Elias-Fano tries, built over and queried from shards.

Documents become blocks of word numbers, kept as a table in the shared folder. Each block sends to each shard of the
model one packed row: its distinct words with their training counts, and its distinct pairs of neighbours with theirs. A
shard adds up what all blocks say, builds the trie of its contexts, answers every block's words and pairs from it, and
sends the answers back; so neither the model nor the counts ever stand in one place, and both grow with the corpus over
more shards. Pairs of a context that is itself a large share of all words are spread over several shards.

A trie has two levels. Contexts are sorted hashes with a count and a back-off weight; Elias-Fano pointers say where
their successors begin. Successors are sorted within their context and stored relative to it, scaled by their number, as
one monotone Elias-Fano sequence with evenly filled buckets: a look-up goes to one bucket and compares what is there.
Probabilities are quantised to 8 bits.

P(w | v) = (c(v w) + k P(w)) / (c(v) + k), P(w) = (c(w) + 1) / (N + V + 1), all from training documents; texts begin
with a start sign as context and end with an end token. Nulls count as empty texts (one end token). A null doc_id hashes
as empty text. Repeated rows count as often as they stand, each giving one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blocks, map_arrow, mix, word_hashes, words, written

END, START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
SCALE = 20.0  # codes a decade
#: Contexts with more than a quarter of a shard's share of all words are spread; no more than four times so many.
HOT = 16_384
NONE = slice(0, 0)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each in a zstd frame."""
    z = zstandard.ZstdCompressor(level=1)
    parts = [z.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at, out, z = 4 * (n + 1), [], zstandard.ZstdDecompressor()
    for size, kind in zip(np.frombuffer(raw, "<u4", n, 4).tolist(), kinds, strict=True):
        out.append(np.frombuffer(z.decompress(raw[at : at + size]), kind))
        at += size
    return out


# the trie


class EliasFano:
    """A rising sequence below 2**64: the lower bits as they are, the upper ones in unary. In memory it is what is in the file
    and, for each 64 bits of the unary part, the number of ones before: places are found by rank and select on those."""

    def __init__(self, values: np.ndarray, low_bits: int):
        self.n, self.low_bits = len(values), low_bits
        v = values.astype(np.uint64)
        self.low = (v & np.uint64((1 << low_bits) - 1)).astype(self.low_type(low_bits))
        high = (v >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(int(high[-1]) + self.n + 1 if self.n else 1, bool)
        bits[high + np.arange(self.n)] = True
        self.bits, self.size = np.packbits(bits, bitorder="little"), len(bits)
        self._index()

    @staticmethod
    def low_type(low_bits: int) -> str:
        return "u1" if low_bits <= 8 else "<u2" if low_bits <= 16 else "<u4"

    def _index(self) -> None:
        self._words = np.pad(self.bits, (0, -len(self.bits) % 8)).view("<u8")
        self._before = np.concatenate(([0], np.cumsum(np.bitwise_count(self._words), dtype=np.uint32))).astype(np.uint32)
        self._zeros_before = (np.arange(len(self._before), dtype=np.int64) * 64 - self._before).astype(np.uint32)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The places of the k-th (from 0) ones or zeros."""
        before = self._before if one else self._zeros_before
        w = np.minimum(np.searchsorted(before, k.astype(np.uint32), "right") - 1, len(self._words) - 1)
        rest, word = k - before[w], self._words[w] if one else ~self._words[w]
        at = w * 64
        for width in (32, 16, 8, 4, 2, 1):
            low = word & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low)
            up = rest >= n
            rest = np.where(up, rest - n, rest)
            word = np.where(up, word >> np.uint64(width), low)
            at += np.where(up, width, 0)
        return at

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, self.size], "<i8"), self.low, self.bits]

    @classmethod
    def of(cls, head: np.ndarray, low: np.ndarray, bits: np.ndarray) -> EliasFano:
        self = cls.__new__(cls)
        self.n, self.low_bits, self.size = map(int, head)
        self.low, self.bits = low, bits
        self._index()
        return self

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low[i].astype(np.uint64)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end index of the elements with these upper bits."""
        zeros = self.size - self.n
        last = max(zeros - 1, 0)
        first = np.where(high > 0, self._select(np.clip(high - 1, 0, last), False) - high + 1, 0)
        end = np.where(high < zeros, self._select(np.clip(high, 0, last), False) - high, self.n)
        gone = high > zeros
        return np.where(gone, self.n, first), np.where(gone, self.n, end)


class Trie:
    """contexts: rising hashes with counts; pairs as (context's index, successor's 32 bits), rising, with counts."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, ctx: np.ndarray, succ: np.ndarray, pair_counts: np.ndarray, k: float):
        degree = np.bincount(ctx, minlength=len(contexts)).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(degree)))
        self.contexts, self.counts = contexts, counts
        self.pointers = EliasFano(starts.astype(np.uint64), 8)
        scaled = (starts[ctx].astype(np.uint64) << np.uint64(32)) + succ.astype(np.uint64) * degree[ctx].astype(np.uint64)
        self.successors = EliasFano(scaled, 32)
        self.codes = quantised(pair_counts / (counts[ctx] + k))

    def to_bytes(self) -> bytes:
        return _pack(self.contexts.astype("<u8"), self.counts.astype("<i8"), *self.pointers.arrays(), *self.successors.arrays(), self.codes)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Trie:
        self = cls.__new__(cls)
        self.contexts, self.counts, *rest, self.codes = _unpack(raw, "<u8", "<i8", "<i8", "u1", "u1", "<i8", "<u4", "u1", "u1")
        self.pointers, self.successors = EliasFano.of(*rest[:3]), EliasFano.of(*rest[3:])
        return self

    def count(self, w: np.ndarray) -> np.ndarray:
        if not len(self.contexts):
            return np.zeros(len(w), np.int64)
        i = np.minimum(np.searchsorted(self.contexts, w), len(self.contexts) - 1)
        return np.where(self.contexts[i] == w, self.counts[i], 0)

    def lookup(self, ctx: np.ndarray, succ: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 for those not in the trie. ctx: hashes."""
        out = np.zeros(len(ctx), np.uint8)
        if not len(self.contexts) or not self.successors.n:
            return out
        i = np.minimum(np.searchsorted(self.contexts, ctx), len(self.contexts) - 1)
        start, end = self.pointers.get(i), self.pointers.get(i + 1)
        ok = np.flatnonzero((self.contexts[i] == ctx) & (end > start))
        want = (start[ok] << np.uint64(32)) + succ[ok].astype(np.uint64) * (end[ok] - start[ok])
        at, stop = self.successors.bucket((want >> np.uint64(32)).astype(np.int64))
        low = (want & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        while len(ok):
            here = at < stop
            ok, at, stop, low = ok[here], at[here], stop[here], low[here]
            hit = self.successors.low[at] == low
            out[ok[hit]] = self.codes[at[hit]]
            on = ~hit
            ok, at, stop, low = ok[on], at[on] + 1, stop[on], low[on]
        return out


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 for probabilities from 1 down; 0 stands for none."""
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-30)) * SCALE) + 1, 1, 255).astype(np.uint8)


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 0, 0.0, 10.0 ** (-(codes.astype(np.float64) - 1) / SCALE))


# blocks


class Block:
    """Documents as numbers of the block's own sorted words."""

    def __init__(self, docs: list, lengths: np.ndarray, train: np.ndarray, vocab: np.ndarray, tokens: np.ndarray):
        self.docs, self.lengths, self.train, self.vocab, self.tokens = docs, lengths, train, vocab, tokens

    @classmethod
    def of(cls, docs: list[int | None], hashes: list[np.ndarray]) -> Block:
        vocab, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        return cls(docs, np.array([len(h) for h in hashes], "<u4"), np.array([not held_out(i) for i in docs], bool), vocab, tokens.astype("<u4"))

    def to_bytes(self) -> bytes:
        ids = np.array([i or 0 for i in self.docs], "<i8")
        null = np.array([i is None for i in self.docs], bool)
        return _pack(ids, null, self.lengths, self.train, self.vocab.astype("<u8"), self.tokens)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Block:
        ids, null, lengths, train, vocab, tokens = _unpack(raw, "<i8", "?", "<u4", "?", "<u8", "<u4")
        return cls([None if n else i for i, n in zip(ids.tolist(), null.tolist(), strict=True)], lengths, train, vocab, tokens)

    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.in_training()], minlength=len(self.vocab))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) as indexes, their training counts, and which pair each token ends. Context len(vocab): the start."""
        before = np.concatenate(([0], self.tokens[:-1])).astype(np.int64)
        before[np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)] = len(self.vocab)
        key = before * np.int64(len(self.vocab) + 1) + self.tokens
        distinct, place = np.unique(key, return_inverse=True)
        n = np.bincount(place[self.in_training()], minlength=len(distinct))
        return distinct // (len(self.vocab) + 1), distinct % (len(self.vocab) + 1), n, place

    def context_hashes(self) -> np.ndarray:
        return np.append(self.vocab, START)


def blocked(docs: DataFrame, block_tokens: int = 2_000_000) -> DataFrame:
    """(block_id, n_train, n_tokens, data): whole documents, about so many tokens in each block."""
    shape = pa.schema([("block_id", pa.int64()), ("n_train", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def run(batches):
        task, made, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shut():
            b = Block.of(ids, held)
            return batch(shape, [[task << 32 | made], [int(b.lengths[b.train].sum())], [size], [b.to_bytes()]])

        for x in blocks(batches, "text"):
            for i, t in zip(x.column("doc_id").to_pylist(), x.column("text").to_pylist(), strict=True):
                ids.append(i)
                held.append(np.append(word_hashes(words(t)), END))
                size += len(held[-1])
                if size >= block_tokens:
                    yield shut()
                    made, ids, held, size = made + 1, [], [], 0
        if ids:
            yield shut()

    return written(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "block_id long, n_train long, n_tokens long, data binary"), compression="none")


def unigrams(table: DataFrame) -> DataFrame:
    """(word hash, training count), from each block's own sums."""
    shape = pa.schema([("w", pa.int64()), ("c", pa.int64())])

    def run(batches):
        for x in batches:
            for raw in x.column("data"):
                b = Block.from_bytes(raw.as_buffer().to_pybytes())
                n = b.word_counts()
                some = n > 0
                w, n = b.vocab[some].view(np.int64), n[some]
                for i in range(0, len(w), 100_000):
                    yield batch(shape, [w[i : i + 100_000], n[i : i + 100_000]])

    return map_arrow(table.select("data"), run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


# shards


class Plan:
    """Which shard answers for what. hot: contexts with their counts, few by construction."""

    def __init__(self, shards: int, hot: dict[int, int], n: int, v: int, k: float):
        self.shards, self.n, self.v, self.k = shards, n, v, k
        self.hot = np.array(sorted(hot), np.uint64)
        self.hot_counts = np.array([hot[h] for h in sorted(hot)], np.int64)
        self.salts = np.maximum(1, np.minimum(shards, -(-self.hot_counts * 2 * shards // max(n, 1))))

    def words(self, w: np.ndarray) -> np.ndarray:
        return (mix(w) % np.uint64(self.shards)).astype(np.int64)

    def pairs(self, ctx: np.ndarray, succ: np.ndarray) -> np.ndarray:
        out = self.words(ctx)
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, ctx), len(self.hot) - 1)
            out = np.where(self.hot[i] == ctx, (out + succ.astype(np.int64) % self.salts[i]) % self.shards, out)
        return out


def _cuts(shards: np.ndarray) -> dict[int, slice]:
    """Where each shard that comes up has its stretch."""
    at = np.flatnonzero(np.diff(shards, prepend=-1))
    return {s: slice(a, e) for s, a, e in zip(shards[at].tolist(), at.tolist(), [*at[1:].tolist(), len(shards)], strict=False)}


def _asked(b: Block, plan: Plan) -> tuple:
    """For each shard, in a fixed order, which words and which pairs of a block it is asked."""
    ctx, word, n, place = b.pairs()
    succ = (mix(b.vocab) >> np.uint64(32)).astype(np.uint32)[word]
    hashes = b.context_hashes()
    to_w, to_p = plan.words(hashes), plan.pairs(hashes[ctx], succ)
    order_w = np.lexsort((hashes, to_w))
    order_p = np.lexsort((succ, hashes[ctx], to_p))
    cut_w, cut_p = _cuts(to_w[order_w]), _cuts(to_p[order_p])
    return hashes, ctx, word, succ, n, place, order_w, order_p, cut_w, cut_p


def _requests(table: DataFrame, plan: Plan) -> DataFrame:
    shape = pa.schema([("shard", pa.int32()), ("block_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for x in batches:
            for block_id, raw in zip(x.column("block_id").to_pylist(), x.column("data"), strict=True):
                b = Block.from_bytes(raw.as_buffer().to_pybytes())
                hashes, ctx, _, succ, n, _, order_w, order_p, cut_w, cut_p = _asked(b, plan)
                seen = np.append(b.word_counts(), b.train.sum())
                for s in sorted(cut_w.keys() | cut_p.keys()):
                    w, p = order_w[cut_w.get(s, NONE)], order_p[cut_p.get(s, NONE)]
                    h = hashes[ctx[p]]
                    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                    data = _pack(hashes[w], seen[w].astype("<u4"), h[new], np.diff(np.append(new, len(h))).astype("<u4"), succ[p], n[p].astype("<u4"))
                    yield batch(shape, [[s], [block_id], [data]])

    return map_arrow(table.select("block_id", "data"), run, "shard int, block_id long, data binary")


def _answers(requests: DataFrame, plan: Plan) -> DataFrame:
    """Each shard: adds up, builds its trie, reads it back from its bytes, answers."""
    shape = pa.schema([("block_id", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])

    def answer(shard: int, rows: list) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(raw, "<u8", "<u4", "<u8", "<u4", "<u4", "<u4") for _, raw in rows]
        every = np.concatenate([p[0] for p in parts])
        w, place = np.unique(every, return_inverse=True)
        c = np.bincount(place, np.concatenate([p[1] for p in parts]), minlength=len(w)).astype(np.int64)
        # contexts of pairs: this shard's words, and hot ones from elsewhere, whose counts the plan has
        ctx = np.unique(np.concatenate([w, *[p[2] for p in parts]]))
        counts = np.zeros(len(ctx), np.int64)
        if len(plan.hot):
            i = np.minimum(np.searchsorted(plan.hot, ctx), len(plan.hot) - 1)
            counts = np.where(plan.hot[i] == ctx, plan.hot_counts[i], 0)
        counts[np.searchsorted(ctx, w)] = c
        key = np.concatenate([np.repeat(np.searchsorted(ctx, p[2]).astype(np.uint64), p[3]) << np.uint64(32) | p[4].astype(np.uint64) for p in parts])
        pair, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, np.concatenate([p[5] for p in parts]), minlength=len(pair)).astype(np.int64)
        pair, n = pair[n > 0], n[n > 0]
        trie = Trie(ctx, counts, (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32), n, plan.k)
        trie = Trie.from_bytes(trie.to_bytes())
        for (block_id, _), p in zip(rows, parts, strict=True):
            codes = trie.lookup(np.repeat(p[2], p[3]), p[4])
            yield batch(shape, [[block_id], [shard], [_pack(trie.count(p[0]).astype("<i8"), codes)]])

    def run(batches):
        now, rows = None, []
        for x in batches:
            for shard, block_id, raw in zip(x.column("shard").to_pylist(), x.column("block_id").to_pylist(), x.column("data").to_pylist(), strict=True):
                if shard != now and rows:
                    yield from answer(now, rows)
                    rows = []
                now = shard
                rows.append((block_id, raw))
        if rows:
            yield from answer(now, rows)

    dealt = requests.repartition(plan.shards, "shard").sortWithinPartitions("shard", "block_id")
    return map_arrow(dealt, run, "block_id long, shard int, data binary")


def _scored(table: DataFrame, answers: DataFrame, plan: Plan) -> DataFrame:
    """Each block meets its answers; sums by document."""
    shape = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(b: Block, asked: tuple, counts: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        _, ctx, word, _, _, place, *_ = asked
        base = np.log10((counts + 1.0) / (plan.n + plan.v + 1.0))
        low = 10.0 ** base[word]
        p = probability(codes) + plan.k / (counts[ctx] + plan.k) * low
        starts = np.concatenate(([0], np.cumsum(b.lengths)[:-1])).astype(np.int64)
        add = lambda x: np.add.reduceat(x, starts)
        return batch(shape, [b.docs, ~b.train, b.lengths.astype(np.int64), add((counts[b.tokens] > 0).astype(np.int64)), np.full(len(b.docs), plan.n, np.int64), add(base[b.tokens]), add(np.log10(np.minimum(p, 1.0))[place])])

    def run(batches):
        b = asked = counts = codes = None
        for x in batches:
            for shard, raw in zip(x.column("shard").to_pylist(), x.column("data").to_pylist(), strict=True):
                if shard < 0:
                    if b is not None:
                        yield finish(b, asked, counts, codes)
                    b = Block.from_bytes(raw)
                    asked = _asked(b, plan)
                    counts, codes = np.zeros(len(b.vocab) + 1, np.int64), np.zeros(len(asked[1]), np.uint8)
                else:
                    order_w, order_p, cut_w, cut_p = asked[6:]
                    c, q = _unpack(raw, "<i8", "u1")
                    counts[order_w[cut_w.get(shard, NONE)]] = c
                    codes[order_p[cut_p.get(shard, NONE)]] = q
        if b is not None:
            yield finish(b, asked, counts, codes)

    both = table.select("block_id", F.lit(-1).alias("shard"), "data").unionByName(answers)
    dealt = both.repartition("block_id").sortWithinPartitions("block_id", "shard")
    return map_arrow(dealt.select("shard", "data"), run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scored(docs: DataFrame, *, k: float = 100.0, shard_tokens: int = 2_000_000) -> DataFrame:
    """Scores of all documents by a model of the training ones (all but those of held_out()). k: weight of the unigrams."""
    table = blocked(docs)
    n, size = table.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    shards = max(2, -(-size // shard_tokens))
    heavy = F.when(F.col("c") * 4 * min(shards, HOT) > n, F.struct("w", "c"))  # fewer than 4 x HOT words can be so frequent
    v, hot = unigrams(table).agg(F.count("*"), F.collect_list(heavy)).first()
    plan = Plan(int(shards), {r.w % (1 << 64): r.c for r in hot}, int(n), int(v), k)
    return _scored(table, _answers(_requests(table, plan), plan), plan)
