"""URL verdicts by native functions only: rules by hand first, mined association rules for the rest.

A URL becomes a set of tokens (labels of its host with their ends, path parts, query names). Token sets that go with a label
are mined level by level; rules are pruned by support and confidence, and stand in an inverted index from token to rule. URLs'
tokens meet the index; a rule fits where all its tokens did. A URL that a rule fits is blocked, all others are allowed.

The mining is whole: a URL is blocked if any set of its tokens has the support among bad URLs and the confidence. Only sets
that can't change that are left out. Sets with too few bad URLs have no larger set with enough. A set that is a rule fits
wherever a larger one does. And a set that stands in the same URLs as one of its own subsets says no more than that one, nor
do larger sets; so a path's parts that always come together cost nothing. Tokens that stand in exactly the same labelled URLs
are mined as one, their first, and the index has each of them in its place (part). Sets grow by joining two that differ in
their last token; equal labelled URLs count together. There is no bound on a URL's tokens: where many of them mix freely, in
many bad URLs each, and no few of them make a rule, the sets are as many as those mixtures.

Labels are the table's: a page is bad if the document of its id has quality 0 or is toxic. Nulls and texts without "://"
have empty host and path. Each page gives one row, repeated rows included; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, "://([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        own, _, rest = r.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens; numbers in the path count as one token."""
    labels = F.transform(F.filter(F.split(host, "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("name:"), x))
    return F.array_distinct(F.concat(labels, parts, names))


def mined(pages: DataFrame, labels: DataFrame, *, support: float = 0.001, least_rows: int = 10, confidence: float = 0.8) -> DataFrame:
    """(rule_id, token, part, size): the index of rules for bad URLs; a rule fits where each of its `size` parts has a token.
    Support is a share of the labelled pages, and least_rows of them at least."""
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    host, path = host_and_path(F.col("url"))
    rows = pages.join(bad, "page_id").select("bad", F.array_sort(tokens(host, path, F.col("url"))).alias("items")).where(F.size("items") > 0)
    rows = rows.groupBy("items").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "items", "n", "n_bad"))
    n = rows.agg(F.sum("n")).first()[0] or 0
    if n < least_rows:
        return pages.sparkSession.createDataFrame([], "rule_id long, token string, part string, size int")
    least = max(support * n, least_rows) - 1e-9
    sums = F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")
    each = rows.select("row", "n", "n_bad", F.explode("items").alias("token"))
    # two sums of row hashes stand for the set of rows
    known = each.groupBy("token").agg(*sums, F.sum(F.shiftright(F.xxhash64("row"), 20)).alias("s1"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "row"), 20)).alias("s2")).where(F.col("n_bad") >= least)
    parts = written(known.groupBy("n", "n_bad", "s1", "s2").agg(F.min("token").alias("part"), F.collect_list("token").alias("tokens")).select("part", "tokens", "n", "n_bad"))  # in one URL all of them
    has = written(each.join(checked(parts.select(F.col("part").alias("token"))), "token"))
    sets = parts.select(F.array("part").alias("s"), "n", "n_bad")
    held = has.select("row", "n", "n_bad", F.array("token").alias("s"))  # which rows have which sets
    rules, size = None, 1
    while True:
        rule = F.col("n_bad") >= confidence * F.col("n") - 1e-9
        rules = sets.where(rule).select("s") if rules is None else rules.unionByName(sets.where(rule).select("s"))
        alive = written(sets.where(~rule))
        if alive.limit(2).count() < 2:
            break
        held = written(held.join(alive.select("s"), "s", "left_semi"))
        head = F.slice("s", 1, size - 1)
        one = held.select("row", "n", "n_bad", head.alias("head"), F.element_at("s", -1).alias("a"))
        two = held.select("row", head.alias("head"), F.element_at("s", -1).alias("b"))
        held = one.join(two, ["row", "head"]).where("a < b").select("row", "n", "n_bad", F.concat("head", F.array("a", "b")).alias("s"))
        found = written(held.groupBy("s").agg(*sums).where(F.col("n_bad") >= least))
        size += 1
        less = found.select("s", "n", "n_bad", F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(F.slice("s", F.lit(1), i - 1), F.slice("s", i + 1, F.lit(size))))).alias("sub"))
        kept = less.join(alive.select(F.col("s").alias("sub"), F.col("n").alias("n_sub")), "sub").where("n_sub > n")
        sets = written(kept.groupBy("s", "n", "n_bad").count().where(F.col("count") == size).select("s", "n", "n_bad"))
    rules = rules.select(F.xxhash64("s").alias("rule_id"), F.explode("s").alias("part"), F.size("s").alias("size"))
    return written(rules.join(parts.select("part", F.explode("tokens").alias("token")), "part").select("rule_id", "token", "part", "size"))


def fitting(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct URLs that some mined rule fits."""
    host, path = host_and_path(F.col("url"))
    each = pages.where("url is not null").select("url", F.explode(tokens(host, path, F.col("url"))).alias("token"))
    met = each.join(checked(index), "token").select("url", "rule_id", "part", "size").distinct()
    return met.groupBy("url", "rule_id").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n = size").select("url").distinct()


def judged(pages: DataFrame, labels: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, support: float = 0.001, confidence: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    pages = pages.select("page_id", "url")
    index = mined(pages, labels, support=support, confidence=confidence)
    host, path = host_and_path(F.col("url"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("_v", verdict)
    bad = checked(written(fitting(pages, index)).withColumn("_bad", F.lit(True)))
    return ruled.join(bad, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"))
