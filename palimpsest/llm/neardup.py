"""Near-duplicate documents: a containment ensemble over MinHash.

Two texts are linked if their sets of five-word shingles contain each other to 0.8 or more, i.e. the common shingles are
at least 0.8 of the larger set. (Every pair with a Jaccard similarity of 0.8 is such a pair. Containment in one direction
only, as of a short text inside a long one, makes no near-duplicate; that search is decontamination's.)

Texts are partitioned by the size of their sets, each partition 1.25 times as wide as the one before, so that linked texts
stand in the same or in neighbouring partitions. For each partition the containment is turned into the least Jaccard
similarity that a linked pair of such sizes can have, in whole shingles, and bands and rows are tuned to that: small sets,
where few overlaps are possible, get long rows. Texts write the band keys of their own partition and of the next.

In a bucket everything is paired with its smallest document first. Pairs whose signatures agree by half are checked
exactly, on the shingle sets, and links are joined by connected components. Links aren't transitive, so bucket mates that
are in different components after that are compared in all pairs, and those that agree by half are checked too: each two
texts that share a bucket and agree by half end in one class or have been checked. This takes signature comparisons in
the square of a bucket's size only where its texts weren't joined.

Nulls count as empty texts. Texts without words are alike, and equal texts always are. Texts of fewer than five words have
one shingle of all their words. Rows without doc_id are left out; a doc_id that repeats counts once, with its smallest text hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blocks, checked, components, map_arrow, mix, only, shingle_hashes, ship, word_hashes, words, written

ROWS = 96
WIDTH = 1.25
_A = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(np.arange(1001, ROWS + 1001, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def partition_of(n: int) -> int:
    return int(math.log(n) / math.log(WIDTH)) if n > 0 else -1


@lru_cache(None)
def bands_of(part: int, least: float = 0.8, recall: float = 0.995) -> tuple[int, int]:
    """(bands, rows) for sets of partitions part - 1 and part: the longest rows that still find a pair at the threshold."""
    low, high = math.floor(WIDTH ** (part - 1)), math.ceil(WIDTH ** (part + 1)) + 1
    worst = 1.0
    for a in {*range(max(1, low), min(high, low + 60) + 1), high}:
        for b in {a, min(high, int(a / least))}:
            o = math.ceil(least * b - 1e-9)
            if o <= a:
                worst = min(worst, o / (a + b - o))
    for rows in range(16, 0, -1):
        bands = ROWS // rows
        if 1 - (1 - worst**rows) ** bands >= recall:
            need = bands if worst >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - worst**rows)) if worst**rows < 1 else 1
            return max(1, min(bands, need)), rows
    return ROWS, 1


def signature_keys(n: int, sig: np.ndarray, part: int) -> np.ndarray:
    """Band keys of one signature for one partition's tuning."""
    bands, rows = bands_of(part)
    rows_of = sig[: bands * rows].astype(np.uint64).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part + 7)
    for r in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + rows_of[:, r])
    return key.view(np.int64)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash of each set, the sets laid end to end so that few calls do."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), ROWS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    at = 0
    while at < len(full):
        take = max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), 60_000, "right")))
        some = full[at : at + take]
        flat = np.concatenate([sets[i] for i in some])
        starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        for k in range(ROWS):
            out[some, k] = np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
        at += take
    return out


SIGNED = "doc_id long, h1 long, h2 long, n_shingles long, sig binary, keys array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """Text hash (128 bits), set size, signature and band keys of each document: one pass over the texts."""
    shape = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in blocks(batches, "text", 4 << 20):
            texts = b.column("text").to_pylist()
            sets = [np.unique(shingle_hashes(word_hashes(words(t)))) for t in texts]
            sigs = _signatures(sets)
            keys, whole = [], [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            for s, sig in zip(sets, sigs, strict=True):
                p = partition_of(len(s))
                keys.append(np.unique(np.concatenate((signature_keys(len(s), sig, p), signature_keys(len(s), sig, p + 1)))).tolist() if len(s) else [])
            h = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            yield batch(shape, [b.column("doc_id"), h[:, 0], h[:, 1], np.array([len(s) for s in sets], np.int64), [s.tobytes() for s in sigs], keys])

    return map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), run, SIGNED)


def _agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Adds est, the share of equal signature rows, to pairs (a, b)."""
    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("est", pa.float64())])

    def run(batches):
        for x in batches:
            if x.num_rows:
                l, r = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint32).reshape(-1, ROWS) for c in ("sig_a", "sig_b"))
                yield batch(shape, [x.column("a"), x.column("b"), (l == r).mean(1)])

    return map_arrow(both, run, "a long, b long, est double")


def met(sigs: DataFrame) -> DataFrame:
    """(key, a, b): each document a of a bucket that isn't its smallest, b."""
    rows = sigs.select(F.explode("keys").alias("key"), "doc_id")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "key").where("doc_id <> b").select("key", F.col("doc_id").alias("a"), "b")


def across(bucketed: DataFrame, sigs: DataFrame, roots: DataFrame, *, likely: float = 0.5, slice_rows: int = 1000) -> DataFrame:
    """Pairs (a, b) of bucket mates in different components whose signatures agree by `likely`; pairs with a bucket's smallest
    are left out, as they were checked before. Large buckets are cut into slices, and all pairs of slices are compared."""
    rows = bucketed.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("key", F.col("a").alias("doc_id"), F.coalesce("root", "a").alias("root"))
    rows = written(rows)
    mixed = rows.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.ceil(F.count("*") / slice_rows).cast("int").alias("slices")).where("r <> s").select("key", "slices")
    rows = rows.join(mixed, "key").withColumn("i", F.pmod(F.xxhash64("doc_id"), "slices").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "doc_id", "root").join(sigs.select("doc_id", "sig"), "doc_id")
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = math.ceil(likely * ROWS)

    def run(t: pa.Table) -> pa.Table:
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        own, docs, root = (t.column(c).to_numpy() for c in ("i", "doc_id", "root"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, ROWS)
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        found = []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            same = np.zeros((len(some), len(right)), np.uint8)
            for k in range(ROWS):
                same += sig[some, k][:, None] == sig[right, k][None]
            x, y = np.nonzero((same >= least) & (root[some][:, None] != root[right][None]))
            x, y = docs[some[x]], docs[right[y]]
            found.append(np.stack([np.maximum(x, y), np.minimum(x, y)]))
        pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], shape)

    ship(rows.sparkSession)
    return rows.groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct()


def linked(sigs: DataFrame, docs: DataFrame, least: float = 0.8, *, likely: float = 0.5) -> DataFrame:
    """Verified pairs (a, b, containment) that join all bucket mates which any links join."""
    bucketed = written(met(sigs))
    first = _agreement(bucketed.select("a", "b").distinct(), sigs).where(F.col("est") >= likely).select("a", "b")
    links = written(verified(first, docs, least))
    more = written(across(bucketed, sigs, written(components(links)), likely=likely))
    if not more.head(1):
        return links
    return links.unionByName(verified(more, docs, least))


def verified(pairs: DataFrame, docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Those pairs (a, b) whose shingle sets contain each other, with the containment. A bucket's smallest document comes
    up in many pairs: joined on b, its rows can be split among tasks, and each task keeps the last set of b."""
    pairs = written(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = written(only(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), ids).dropDuplicates(["doc_id"]))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("containment", pa.float64())])

    def run(batches):
        last, held = None, None
        for big in batches:
            for x in blocks([big], "text_a"):
                out = []
                for a, b, ta, tb in zip(*(x.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                    if b != last:
                        last, held = b, np.unique(shingle_hashes(word_hashes(words(tb))))
                    s = np.unique(shingle_hashes(word_hashes(words(ta))))
                    most = max(len(s), len(held))
                    c = len(np.intersect1d(s, held, assume_unique=True)) / most if most else 1.0
                    if c >= least - 1e-12:
                        out.append((a, b, c))
                yield batch(shape, [list(z) for z in zip(*out, strict=True)] if out else [[], [], []])

    return map_arrow(both, run, "a long, b long, containment double")


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), n_shingles, n_links (verified links of its text to other texts)."""
    sigs = written(signed(docs))
    wordless = F.col("n_shingles") == 0
    one = sigs.groupBy("doc_id").agg(F.min_by(F.struct("h1", "h2", "n_shingles"), F.struct("h1", "h2")).alias("x")).select("doc_id", "x.*")
    sigs, one = (x.withColumns({h: F.when(wordless, 0).otherwise(F.col(h)) for h in ("h1", "h2")}) for x in (sigs, one))
    # Only hashes that several texts have are joined, from a table of their own: a join that isn't in one stage with the
    # aggregate can be broadcast, or its large groups split.
    copies = written(sigs.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last"))
    member = written(one.join(checked(copies), ["h1", "h2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n_shingles"))
    texts = sigs.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").where("n_shingles > 0").dropDuplicates(["doc_id"])
    texts = written(texts.select("doc_id", "n_shingles", "sig", "keys"))
    links = written(linked(texts, docs, least))
    roots = components(links)
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(n, "rep", "left")
    return out.select("doc_id", F.coalesce("root", "rep").alias("class_id"), "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))
