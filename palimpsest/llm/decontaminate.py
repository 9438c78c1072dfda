"""Benchmark items inside documents, by native functions only.

An item is in a document if at least 0.8 of the item's distinct five-word shingles are (containment, so a short item is
found in a document of any length). Items are partitioned by size. For each partition the MinHash sketch is the items' k
smallest shingle hashes, with k just large enough for its largest item that one of them must be in any document with the
asked containment: at most n - ceil(0.8 n) shingles may be missing, so one more is asked. So the search loses no pair.
Documents' shingle hashes meet the sketches in one join; pairs that meet are then verified on the shingles' words.

Words are runs without ASCII white space, in lower case. Items of fewer than five words have no shingle and match nothing;
nulls count as empty. Documents that share a doc_id are taken together; rows without doc_id or item_id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, only, without, written

SPACE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


def word_array(text: Column) -> Column:
    """Words in lower case; empty for null."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _starts(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def shingle_ids(hashes: Column, k: int = 5) -> Column:
    """A 64-bit hash for each k consecutive word hashes."""
    return F.transform(_starts(hashes, k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def word_shingles(words: Column, k: int = 5) -> Column:
    return F.transform(_starts(words, k), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    """One row per shingle hash. The steps stand apart, so that each array is made once per text."""
    w = df.select(*keep, word_array(F.col("text")).alias("_w"))
    h = w.select(*keep, F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    return h.select(*keep, F.explode(shingle_ids(F.col("_h"))).alias("shingle"))


def sketches(items: DataFrame, least: float = 0.8, width: float = 1.25) -> DataFrame:
    """(item_id, shingle): of each item the k smallest shingle hashes, k by its size's partition."""
    every = _hashed(items, "item_id").groupBy("item_id").agg(F.array_sort(F.collect_set("shingle")).alias("s"))  # one item's own
    largest = F.floor(F.pow(F.lit(width), F.floor(F.log(F.size("s").cast("double")) / F.log(F.lit(width))) + 1)) + 1
    k = largest - F.ceil(F.lit(least) * largest) + 1
    return every.select("item_id", F.explode(F.slice("s", 1, F.greatest(k, F.lit(1)).cast("int"))).alias("shingle"))


def candidates(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    sketch = checked(sketches(items.where("item_id is not null"), least))
    return _hashed(docs.where("doc_id is not null"), "doc_id").join(sketch, "shingle").select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, *, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found, containment."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    items = items.where("item_id is not null").select("item_id", "text")
    pairs = written(candidates(docs, items, least))
    of = lambda df, key: df.select(key, word_array(F.col("text")).alias("_w")).select(key, F.explode(F.array_distinct(word_shingles(F.col("_w")))).alias("words"))
    wanted = written(of(items, "item_id").distinct())
    sizes = wanted.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    found = of(only(docs, pairs), "doc_id").join(checked(wanted), "words").distinct()
    counts = found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_found"))
    out = counts.join(checked(sizes), "item_id").join(pairs, ["doc_id", "item_id"], "left_semi").where(F.col("n_found") >= F.ceil(F.col("n_shingles") * least - 1e-9))
    return out.select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, *, least: float = 0.8) -> DataFrame:
    """The documents that hold no item; those without doc_id stay."""
    return without(docs, written(contained(docs, items, least=least).select("doc_id").distinct()))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
 b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
 ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
 bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
 n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1),
 f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, CAST(n_found AS DOUBLE) / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles
"""
