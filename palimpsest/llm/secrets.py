"""Secrets in texts, by native functions only.

Three patterns give base spans: assignments of passwords and the like, access keys, and long hexadecimal runs. Beside them,
runs of LEAST_RUN or more token characters with a letter and a digit are weighed by two character Markov models, one of
random strings and one of ordinary identifiers, trained from labelled samples: where the log-likelihood ratio is high in sum
and per character, the run is a span of kind markov, also if it overlaps a base span. The bound per character is fitted: it
stands two thirds of the way from what one in a thousand of the labelled identifiers exceeds to what all but one in a
thousand of the labelled random strings exceed. Shorter runs and runs of letters only
aren't weighed, as words of a language that the samples don't have look as odd to the models as random letters.

Places are code points, ends exclusive. A text is cut by each pattern once for what matches and, only if something does,
once for what stands between; lengths summed up give the places. Sums run in chunks whose number and length both go with
the root of the number of matches, as native arrays are copied at each step. Nulls count as empty texts and have no span. Rows pass one
by one, so repeated rows and other columns are as they were.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"  # shorter runs would fail anyway
_TOKEN = "[A-Za-z0-9+/=_-]"
LEAST_RUN = 16
RUN = f"(?<!{_TOKEN})(?=[A-Za-z+/=_-]*+[0-9])(?=[0-9+/=_-]*+[A-Za-z]){_TOKEN}{{{LEAST_RUN},}}"
KINDS = ("assign", "access", "hex", "markov")
SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-."
_N = len(SIGNS) + 1


def _found(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def _chunks(values: Column) -> Column:
    """An array of arrays: as many chunks as each has elements, about. (The array of one binds the values, which would
    else be worked out again for each chunk.)"""
    n = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
    last = lambda v: F.greatest(F.ceil(F.size(v) / n(v)).cast("int") - 1, F.lit(0))
    return F.transform(F.array(values), lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda i: F.slice(v, i * n(v) + 1, n(v))))[0]


def _places(text: str, matches: str, pattern: str, kind: int) -> Column:
    """(start, kind, end, found) of each match, from the lengths of matches and of what stands between them."""
    none = F.array().cast(SPANS)
    both = F.zip_with(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(matches)), F.col(matches), lambda g, h: F.struct(F.char_length(g).alias("gap"), F.char_length(h).alias("n"), h.alias("hit")))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["n"]).alias("at"),
        F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["hit"].alias("found"))).alias("out"),
    )
    # (what chunks before came to, their places), a chunk at a time
    over = lambda acc, chunk: F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), step)
    each = lambda acc, chunk: F.transform(F.array(over(acc, chunk)), lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))[0]
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.when(F.size(matches) > 0, F.flatten(F.aggregate(_chunks(both), begin, each)["out"])).otherwise(none)


SPANS = "array<struct<start:int,kind:int,end:int,found:string>>"


# the models


def labelled_samples(words: DataFrame, *, rows: int = 4000) -> DataFrame:
    """(sample, random): digests of numbers in several alphabets, and identifiers put together from ordinary words.

    words: a column `word`; at most rows of them are used, by hash order. So the models rest on bounded samples.
    """
    spark = words.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.base64(F.unhex(digest))
    noise = spark.range(rows).select(F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))).when(F.col("id") % 4 == 2, F.translate(b64, "+/=", "-_")).otherwise(b64).alias("sample"), F.lit(True).alias("random"))
    w = words.where("word rlike '^[A-Za-z]{3,}$'").select(F.col("word")).distinct().orderBy(F.xxhash64("word"), "word").limit(rows)
    number = F.abs(F.xxhash64("word")) % 3000
    cap, low = F.initcap("word"), F.lower("word")
    plain = w.select(F.explode(F.array(F.concat_ws("_", low, low, number.cast("string")), F.concat(low, cap, F.lit("2")), F.concat_ws("-", number.cast("string"), low, F.lit("v1")), F.concat_ws("/", low, cap, F.concat(low, F.lit("_"), number.cast("string"))), F.concat(F.upper("word"), F.lit("_"), F.upper("word")), F.concat_ws("-", F.lit("2024"), F.lit("01"), (number % 28).cast("string")))).alias("sample"), F.lit(False).alias("random"))
    return noise.unionByName(plain)


def transitions(samples: DataFrame) -> list[float]:
    """For each pair of signs the log of how much likelier the random model steps from one to the other (add-one smoothed)."""
    at = lambda i: F.instr(F.lit(SIGNS), F.substring("sample", i, F.lit(1)))
    pairs = samples.where("char_length(sample) > 1").select("random", F.explode(F.sequence(F.lit(1), F.char_length("sample") - 1)).alias("i"), "sample").select("random", at(F.col("i")).alias("a"), at(F.col("i") + 1).alias("b"))
    counts = {(r.random, r.a, r.b): r.n for r in pairs.groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}  # 2 x 69 x 69 at most
    rows = {(k, a): sum(counts.get((k, a, b), 0) for b in range(_N)) for k in (True, False) for a in range(_N)}
    p = lambda k, a, b: (counts.get((k, a, b), 0) + 0.5) / (rows[k, a] + 0.5 * _N)
    return [math.log(p(True, a, b) / p(False, a, b)) for a in range(_N) for b in range(_N)]


def log_ratio(found: Column, table: list[float]) -> Column:
    """Sum over the string's steps."""
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded to one constant
    codes = F.transform(F.split(found, ""), lambda c: F.instr(F.lit(SIGNS), c))
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(values, a * _N + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


# the scan


def scanned(docs: DataFrame, model: tuple[list[float], float], *, text: str = "text", least_sum: float = 8.0) -> DataFrame:
    """Adds base and spans, arrays of (start, kind, end, found) ordered by start, then kind (an index into KINDS).
    model: as from trained()."""
    table, least_each = model
    rest = [F.col(c) for c in docs.columns if c not in ("base", "spans")]
    df = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    patterns = dict(zip(("_m0", "_m1", "_m2", "_m3"), (ASSIGN, ACCESS, HEX, RUN), strict=True))
    df = df.select("*", *[_found("_t", p).alias(m) for m, p in patterns.items()])
    df = df.select("*", *[_places("_t", m, p, k).alias(f"_s{k}") for k, (m, p) in enumerate(patterns.items())])
    long_enough = F.filter("_s0", lambda x: F.char_length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 12)
    df = df.withColumn("base", F.array_sort(F.concat(long_enough, "_s1", "_s2")))
    ratio = lambda x: F.transform(F.array(log_ratio(x["found"], table)), lambda r: (r >= least_sum) & (r >= (x["end"] - x["start"] - 1) * least_each))[0]
    sure = F.filter("_s3", ratio)
    df = df.withColumn("_extra", F.when(F.size("_s3") > 0, sure).otherwise(F.array().cast(SPANS)))
    return df.withColumn("spans", F.when(F.size("_extra") > 0, F.array_sort(F.concat("base", "_extra"))).otherwise(F.col("base"))).drop("_t", "_extra", *patterns, *[f"_s{k}" for k in range(4)])


def written_out(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def trained(docs: DataFrame, *, sample_docs: int = 500, wrong: float = 0.001) -> tuple[list[float], float]:
    """(transitions, bound per character) from words of a bounded sample of documents (sample_docs, by hash order of ids) and
    from digests. wrong: the share of labelled identifiers that may reach the bound."""
    ids = [r.doc_id for r in docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    some = docs.where(F.col("doc_id").isin(ids)).select("text") if ids else docs.limit(0).select("text")
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("word"))
    samples = written(labelled_samples(words))
    table = transitions(samples)
    each = samples.where(f"char_length(sample) >= {LEAST_RUN}").select("random", (log_ratio(F.col("sample"), table) / (F.char_length("sample") - 1)).alias("r"))
    plain, noise = each.agg(F.percentile(F.when(~F.col("random"), F.col("r")), 1 - wrong), F.percentile(F.when(F.col("random"), F.col("r")), wrong)).first()
    return table, (plain + 2 * noise) / 3 if plain is not None and plain < noise else 0.45


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, SHA-256 of the base spans, and all spans, written out."""
    made = scanned(docs.select("doc_id", "text"), trained(docs))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return made.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written_out("base").cast("binary"), 256).alias("base_sha256"), written_out("spans").alias("spans"))


def redacted(docs: DataFrame, *, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by the mark (overlapping ones by one), n_chars brought up to date."""
    columns = docs.columns
    made = scanned(docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(columns)] + [F.col("text").alias("_text")]), trained(docs), text="_text")
    # Spans that overlap become one, (start, end) in order; then what stands between them is put together again.
    none = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.when(x["start"] >= acc["at"], F.array_append(acc["out"], F.struct(acc["at"].alias("start"), x["start"].alias("end")))).otherwise(acc["out"]).alias("out"),
    )
    over = lambda acc, chunk: F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), step)
    each = lambda acc, chunk: F.transform(F.array(over(acc, chunk)), lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))[0]
    made = made.withColumn("_d", F.when(F.size("spans") > 0, F.aggregate(_chunks(F.col("spans")), F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out")), each)))
    gaps = F.concat(F.flatten("_d.out"), F.array(F.struct(F.col("_d.at").alias("start"), F.char_length("_text").alias("end"))))
    cut = F.transform(gaps, lambda g: F.substring(F.col("_text"), g["start"] + 1, g["end"] - g["start"]))
    signs = F.split(F.col("_text"), "")  # with many spans: a substring is looked for from the text's beginning each time
    cut_signs = F.transform(F.array(signs), lambda every: F.transform(gaps, lambda g: F.array_join(F.slice(every, g["start"] + 1, g["end"] - g["start"]), "")))[0]
    new = F.when(F.size("spans") > 100, F.array_join(cut_signs, mark)).when(F.size("spans") > 0, F.array_join(cut, mark)).otherwise(F.col("_text"))
    made = made.withColumn("_new", new)
    changed = {"text": F.col("_new"), "n_chars": F.when(F.size("spans") > 0, F.char_length("_new").cast("long"))}
    return made.select([F.coalesce(changed[c], F.col(f"c{i}")).alias(c) if c in changed else F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
