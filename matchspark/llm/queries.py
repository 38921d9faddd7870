"""The registered query of each operator, with production parameters, and the SQL oracles that exist."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchspark.llm.bpe import bpe_digests
from matchspark.llm.collocations import collocations
from matchspark.llm.exact_dedup import exact_dedup
from matchspark.llm.fingerprints import fingerprints
from matchspark.llm.html_text import html_text
from matchspark.llm.language_id import language_id
from matchspark.llm.lm_score import lm_score
from matchspark.llm.maxscore import maxscore_search
from matchspark.llm.near_dedup import near_components
from matchspark.llm.packing import pack
from matchspark.llm.resample import importance_resample
from matchspark.llm.suffix_dedup import suffix_dedup
from matchspark.llm.url_filter import url_filter

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers that were started elsewhere import this package, and keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)


def query(name: str, tables: str, sql: str | None = None):
    """Register ``fn(*tables)`` as ``name``; ``tables`` are names with spaces between."""

    def wrap(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(*(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables.split()))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_exact_dedup", "documents", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
""")
def op1_exact_dedup(documents: DataFrame) -> DataFrame:
    return exact_dedup(documents).drop("fp")


@query("op2_bpe", "documents")
def op2_bpe(documents: DataFrame) -> DataFrame:
    return bpe_digests(documents, public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_pack", "documents")
def op4_pack(documents: DataFrame) -> DataFrame:
    return pack(documents, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


@query("op3_url_filter", "pages", f"""
WITH r(rh, rp, rv) AS ({RULES}),
u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT p.host, p.path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path
""")
def op3_url_filter(pages: DataFrame) -> DataFrame:
    return url_filter(pages, pages.sparkSession.sql(f"SELECT * FROM {RULES} AS rules(host, path, verdict)"))


@query("op9_language_id", "documents")
def op9_language_id(documents: DataFrame) -> DataFrame:
    return language_id(documents)


@query("op8_fingerprints", "documents")
def op8_fingerprints(documents: DataFrame) -> DataFrame:
    return fingerprints(documents)


@query("op7_lm_score", "documents")
def op7_lm_score(documents: DataFrame) -> DataFrame:
    return lm_score(documents)


@query("op6_suffix_dedup", "documents")
def op6_suffix_dedup(documents: DataFrame) -> DataFrame:
    return suffix_dedup(documents)


@query("op10_near_dedup", "documents")
def op10_near_dedup(documents: DataFrame) -> DataFrame:
    return near_components(documents, width=2, percent=80)


@query("op5_html_text", "pages")
def op5_html_text(pages: DataFrame) -> DataFrame:
    return html_text(pages)


@query("op13_resample", "documents benchmark")
def op13_resample(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return importance_resample(documents, benchmark, percent=5, least_words=20, seed=42).select("doc_id", "n_features", "weight", "score", "rank")


@query("op11_maxscore", "embeddings", """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum([q.c[i] * v.c[i] FOR i IN range(1, len(q.c) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
""")
def op11_maxscore(embeddings: DataFrame) -> DataFrame:
    return maxscore_search(embeddings, k=10, scale=1024, every=100)


@query("op12_collocations", "documents", """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \\t]+') IF x <> ''] AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM p, unnest(range(1, 6)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
o AS (SELECT lang, phrase, max(a) AS o FROM (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM c, unnest(range(2, k)) AS x(m), unnest(range(1, k - m + 2)) AS y(i)) GROUP BY ALL),
s AS (SELECT c.lang, c.phrase, c.a, n.n, j, l.f AS l, r.f AS r, CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM c LEFT JOIN o ON o.lang = c.lang AND o.phrase = c.phrase, unnest(range(1, c.k)) AS x(j)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ') JOIN n ON n.lang = c.lang
  WHERE o.o IS NULL OR 100 * o.o < 100 * c.a),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b QUALIFY rank <= 2000
""")
def op12_collocations(documents: DataFrame) -> DataFrame:
    return collocations(documents, least=100, longest=5, top=2000, percent=100)
