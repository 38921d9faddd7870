"""URL rules through a blocked Bloom filter and an exact hash join, in DataFrame functions only.

A rule lists a canonical URL prefix: a host with all its subdomains, and a path prefix. A page's possible rules are the
suffixes of its host with the prefixes of its path, at the path lengths that rules have. The Bloom filter keeps one block
of four 64-bit words per row; a candidate reads one block and must find one bit in each word. What passes is joined with
the listed rules by the whole string, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import ascii_lower, sized

WORDS = 4
#: Listed URLs per block of 256 bits: 16 bits each, about 0.1 % false positives.
BLOCK_KEYS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(whole, form, 1)), F.regexp_extract(whole, form, 2)


def marks(key: Column) -> list[Column]:
    """The bit that ``key`` sets in each word of its block."""
    bits = F.xxhash64(key, F.lit("bits"))
    place = [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in place]


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of column ``key``: block and its words w0 to w3. Blocks without keys are absent."""
    marked = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(marks(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def possible(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Candidates (column ``key``) that the filter may hold."""
    probe = candidates.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(bloom, "block")
    for i, mark in enumerate(marks(F.col("key"))):
        probe = probe.where(F.col(f"w{i}").bitwiseAND(mark) != 0)
    return probe.drop("block", *[f"w{i}" for i in range(WORDS)])


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: its id, host, path, rule and verdict.

    ``rules`` has host, path and verdict. A rule fits its host and subdomains if the page's path starts with the rule's;
    the longest wins (of equal length the one with the longer host, then the first in order). Pages without a rule get
    a null rule and ``default``: what is not listed passes. A null url has an empty host and path and is judged like
    any other. Repeated rows and null ids stay; repeated rules count once; other columns are ignored.
    """
    listed = rules.select(
        F.concat(ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("path_length"), "verdict",
    ).groupBy("key").agg(F.max("path_length").alias("path_length"), F.min("verdict").alias("verdict"))
    n = listed.count()
    lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())  # bounded by the longest path of a rule
    blocks = max(1, n // BLOCK_KEYS)
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length("path") >= k, F.expr(f"left(path, {k})")) for k in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda p: F.concat(e, p))))
    candidates = judged.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
    bloom = blocked_bloom(listed.select("key"), blocks)
    hits = possible(candidates, sized(bloom, blocks, 8 * (WORDS + 1)), blocks).join(sized(listed, n, 200), "key")
    order = F.struct(F.length("key").alias("size"), (-F.col("path_length")).alias("host_first"), F.col("key").alias("rule"), "verdict")
    best = hits.groupBy("host", "path").agg(F.max(order).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
