"""Quality by document, host and path: hierarchical empirical Bayes.

A document's own evidence is the log-odds that it is good (labelled quality 1 and not toxic): a logistic regression on
binned shape features (case, symbols, repetition, lengths) and a word list for toxic labels, both learned from a bounded
sample of labelled documents (sample_rows, by hash order of ids). Everything else covers all documents: good evidence is
summed by path and by host, prior strengths come from the spread of those sums (method of moments), a host's posterior is
shrunk towards the global mean and a path's towards its host's, so that a site with few documents says little. The last
log-odds are the document's own, moved by how far its path's posterior stands from the global mean; 0 or more is kept.

host is the source up to its first slash, path what follows. Null or empty sources make one site; null texts count as
empty. Rows pass one by one: repeated rows stay, other columns pass through. Without labels of both kinds the evidence is 0
and everything is kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blocks, checked, map_arrow, written

SAMPLE_ROWS = 20_000
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
_MARKS = ".,;:!?\"'()"
#: Beginnings of words count as words do, marked by a caret: they carry over to forms that the sample didn't have.
_STEMS = range(4, 8)
_EDGES = {
    "upper": [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "symbols": [0.0005, 0.002, 0.01, 0.03, 0.08, 0.2],
    "digits": [0.001, 0.01, 0.05, 0.15],
    "distinct": [0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95],
    "stutter": [0.005, 0.02, 0.1, 0.3],
    "word": [2.5, 3.5, 4.5, 5.5, 6.5, 8, 11],
    "length": [1, 3, 6, 12, 25, 50, 100, 400, 1600],
    "same_lines": [0.02, 0.1, 0.25, 0.5],
}
WIDTH = sum(len(e) + 1 for e in _EDGES.values())


def features(text: str | None) -> tuple[list[int], set[str]]:
    """The index of each feature's bin, and the distinct words in lower case without marks at their ends."""
    t = text or ""
    raw, found = t.encode("utf-8", "surrogatepass"), t.split()
    n, size = max(len(found), 1), max(len(raw), 1)
    lines = [x for x in t.split("\n") if x.strip()]
    distinct = set(found)
    share = lambda signs: 1 - len(raw.translate(None, signs)) / size if raw else 0.0
    values = (
        share(_UPPER),
        share(_SYMBOLS),
        share(_DIGITS),
        len(distinct) / n,
        sum(map(eq, found, found[1:])) / n,
        len(t) / n - 1,
        len(found),
        1 - len(set(lines)) / max(len(lines), 1),
    )
    out, base = [], 0
    for v, edges in zip(values, _EDGES.values(), strict=True):
        out.append(base + bisect_right(edges, v))
        base += len(edges) + 1
    return out, {w.strip(_MARKS) for w in set(t.lower().split())}


def with_stems(distinct: set[str]) -> set[str]:
    return distinct | {f"^{w[:n]}" for w in distinct for n in _STEMS if len(w) >= n}


class Model:
    """weights of bins and intercept; words and stems with the log-ratio by which they are commoner in toxic texts."""

    def __init__(self, weights: np.ndarray, intercept: float, words: dict[str, float], toxic_prior: float):
        self.weights, self.intercept, self.toxic_prior = weights, intercept, toxic_prior
        self.words = {w: r for w, r in words.items() if w[:1] != "^"}
        self.stems = {w[1:]: r for w, r in words.items() if w[:1] == "^"}
        self._heads, self._lengths = {w[:4] for w in self.stems}, sorted({len(w) for w in self.stems})

    def evidence(self, text: str | None) -> float:
        """The strongest toxic word counts, not their sum: stems and words say the same over again."""
        bins, distinct = features(text)
        q = self.intercept + float(self.weights[bins].sum())
        signs = [self.words[w] for w in distinct & self.words.keys()]
        if self._heads:
            signs += [self.stems.get(w[:n], 0.0) for w in distinct if w[:4] in self._heads for n in self._lengths]
        toxic = self.toxic_prior + max(signs, default=-5.0)
        p = 1 / (1 + np.exp(-q)) / (1 + np.exp(toxic))  # good quality and not toxic
        return float(np.log(p) - np.log1p(-p)) if 0 < p < 1 else (-30.0 if p <= 0 else 30.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's steps on one-hot rows given by bin indexes."""
    n = len(x)
    full = np.zeros((n, WIDTH + 1))
    full[np.arange(n)[:, None], x] = 1
    full[:, -1] = 1
    w = np.zeros(WIDTH + 1)
    penalty = np.full(WIDTH + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p) + 1e-9)[:, None]).T @ full + np.diag(penalty), full.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, list_words: int = 300, min_share: float = 0.04) -> Model:
    """Learns from at most sample_rows labelled documents. What reaches the driver is bounded by sample_rows and list_words.

    Listed words stand in min_share of the toxic sample at least: rarer ones come with single texts and their copies.
    """
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    some = F.broadcast(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # Of rows that share an id one counts, the one with the smallest text hash, so that repeated ids don't swell the sample.
    rows = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "quality", "toxic"), F.struct(F.xxhash64("text"), "text")).alias("x")).select("x.*")
    shape = pa.schema([("bins", pa.list_(pa.int32())), ("quality", pa.int32()), ("toxic", pa.int32()), ("word", pa.string()), ("in_toxic", pa.int64()), ("in_other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            seen = (Counter(), Counter())
            made = [features(t) for t in b.column("text").to_pylist()]
            quality, toxic = b.column("quality").to_pylist(), b.column("toxic").to_pylist()
            for (_, distinct), t in zip(made, toxic, strict=True):
                seen[0 if t else 1].update(with_stems(distinct))
            none = [None] * b.num_rows
            yield batch(shape, [[x for x, _ in made], quality, toxic, none, none, none])
            every = list(seen[0].keys() | seen[1].keys())
            none = [None] * len(every)
            yield batch(shape, [none, none, none, every, [seen[0][w] for w in every], [seen[1][w] for w in every]])

    table = written(map_arrow(rows, run, "bins array<int>, quality int, toxic int, word string, in_toxic long, in_other long"))
    got = table.where("bins is not null").select("bins", "quality", "toxic").collect()  # sample_rows at most
    y = np.array([r.quality for r in got])
    toxic = sum(1 for r in got if r.toxic)
    if not len(y) or y.min() == y.max():
        weights, intercept = np.zeros(WIDTH), 30.0
    else:
        weights, intercept = _logistic(np.array([r.bins for r in got]), y)
    words, prior = {}, -30.0
    if 0 < toxic < len(got):
        other = len(got) - toxic
        rate_t, rate_o = (F.col("in_toxic") + 0.05) / (toxic + 0.1), (F.col("in_other") + 0.05) / (other + 0.1)
        found = table.where("word not in ('', '^')").groupBy("word").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_other").alias("in_other"))
        best = found.where(F.col("in_toxic") >= max(5, min_share * toxic)).withColumn("ratio", F.log(rate_t / rate_o)).where("ratio > 3.5").orderBy(F.desc(F.col("ratio") * F.col("in_toxic")), "word").limit(list_words)
        words = {r.word: float(r.ratio) for r in best.collect()}
        prior = float(np.log(toxic / other)) if words else -30.0
    return Model(weights, intercept, words, prior)


def with_evidence(docs: DataFrame, model: Model, *, keep_text: bool = True) -> DataFrame:
    """Adds the column evidence; all other columns stay (without keep_text, all but text)."""
    rest = [c for c in docs.columns if c != "evidence" and (keep_text or c != "text")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*rest, "evidence"]

    def run(batches):
        for b in blocks(batches, "text"):
            e = pa.array([sent.value.evidence(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), e], names=names)

    return map_arrow(docs.select(*dict.fromkeys([*rest, "text"])), run, docs.select(*rest, F.lit(0.0).alias("evidence")).schema)


def _site(df: DataFrame) -> DataFrame:
    source = F.coalesce(F.col("source"), F.lit(""))
    return df.withColumn("_host", F.substring_index(source, "/", 1)).withColumn("_path", F.regexp_extract(source, "^[^/]*/(.*)$", 1))


def sites(evidence: DataFrame) -> DataFrame:
    """(_host, _path, host_posterior, path_posterior, shift) from (source, evidence) of all documents."""
    p = F.lit(1.0) / (1 + F.exp(-F.col("evidence")))
    paths = written(_site(evidence).groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(p).alias("s")))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("paths"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("hosts")).first()
    mean = min(max((total.s or 0.0) / max(total.n or 1, 1), 1e-4), 1 - 1e-4)
    spread = mean * (1 - mean)

    def strength(rows: DataFrame, n: str, m, centre, groups: int) -> float:
        """Pseudo-counts of a beta prior: the variance between groups, less what sampling alone makes."""
        between, weight = rows.agg(F.sum(F.col(n) * (m - centre) ** 2), F.sum(n)).first()
        between = (between or 0.0) / max(weight or 1, 1) - spread * groups / max(weight or 1, 1)
        return float(min(max(spread / max(between, 1e-6) - 1, 2.0), 1e5))

    k_host = strength(hosts, "hn", F.col("hs") / F.col("hn"), F.lit(mean), total.hosts or 1)
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + k_host * mean) / (F.col("hn") + k_host))
    both = paths.join(hosts.select("_host", "hn", "hs", "host_posterior"), "_host")
    k_path = strength(both, "n", F.col("s") / F.col("n"), F.col("hs") / F.col("hn"), both.count())
    logit = lambda c: F.log(c) - F.log(1 - c)
    post = F.least(F.greatest((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path), F.lit(1e-4)), F.lit(1 - 1e-4))
    out = both.withColumn("path_posterior", post)
    return written(out.select("_host", "_path", "host_posterior", "path_posterior", (logit(F.col("path_posterior")) - float(np.log(mean / (1 - mean)))).alias("shift")))


def judged(evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds host_posterior, path_posterior, score and keep to rows with evidence; columns of these names are replaced."""
    clash = [c for c in ("host_posterior", "path_posterior", "shift", "score", "keep") if c in evidence.columns]
    out = _site(evidence.drop(*clash)).join(checked(groups), ["_host", "_path"], "left").drop("_host", "_path")
    return out.withColumn("score", F.col("evidence") + F.coalesce("shift", F.lit(0.0))).withColumn("keep", F.col("score") >= 0).drop("shift")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, evidence, host_posterior, path_posterior, score, keep."""
    evidence = written(with_evidence(docs.select("doc_id", "source", "text"), fit(docs, labels), keep_text=False))
    return judged(evidence, sites(evidence)).select("doc_id", "source", "evidence", "host_posterior", "path_posterior", "score", "keep")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns. The second pass over the texts is cheaper than dealing them out by id."""
    model = fit(docs, labels)
    evidence = written(with_evidence(docs.select("doc_id", "source", "text"), model, keep_text=False))
    every = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])  # extra columns can't clash
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    scored = with_evidence(every.withColumn("text", F.col(at["text"])), model, keep_text=False).withColumn("source", F.col(at["source"]))
    return judged(scored, sites(evidence)).where("keep").select([F.col(at[c]).alias(c) for c in docs.columns])
