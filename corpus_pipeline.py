"""A corpus pipeline: language ID, exact dedup, near-dedup, removal of repeated passages, packing.

Every stage takes all documents that its predecessor kept. The first four return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.llm.common import ascii_lower, row_key, sized, texts
from matchspark.llm.exact_dedup import exact_dedup
from matchspark.llm.language_id import held_out, predict, train
from matchspark.llm.near_dedup import near_components
from matchspark.llm.packing import pack
from matchspark.llm.queries import ship
from matchspark.llm.suffix_dedup import cut_text, repeated_spans
from matchspark.session import cut_lineage

#: Columns that the stages read or write; all others are hidden from the joins by names of their own.
USED = ("doc_id", "text", "lang", "n_chars")


def hidden(docs: DataFrame) -> DataFrame:
    """``docs`` with only the names of USED, so that no further column can clash with what a stage joins in."""
    return docs.toDF(*[c if c in USED else f"further_{i}" for i, c in enumerate(docs.columns)])


def empty_text() -> Column:
    return F.coalesce("text", F.lit(""))


def without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, key) is not in ``dropped`` (doc_id, key)."""
    gone = cut_lineage(dropped.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")))
    gone = sized(gone, gone.count(), 32)
    return docs.join(gone, (key == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject.

    It rejects texts without any letter, null and empty ones too, and no others: a text of mixed or unknown language is
    kept, however unsure its language. Where no row has a language to learn from, texts with a letter are kept. Repeated
    rows and null ids stay; an empty table stays empty.
    """
    ship(spark)
    plain = hidden(docs)
    known = plain.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    model = train(known.select("doc_id", empty_text().alias("text"), "lang"))
    found = predict(plain, model, keep_text=True)
    keep = F.col("lang_pred") != "und" if model.languages else empty_text().rlike(r"\p{L}")
    return found.where(keep).select(plain.columns).toDF(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal after lower-casing A-Z: the largest doc_id.

    Null and empty texts equal each other. Of a row written more than once one stays; a null id loses to any other. An
    empty table stays empty.
    """
    ship(spark)
    plain = hidden(docs)
    found = cut_lineage(exact_dedup(plain).select("doc_id", "keep_id", "kept", F.col("fp").alias("key")))
    fp = F.xxhash64(ascii_lower(empty_text()))
    stays = without(plain, found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))), fp)
    twice = cut_lineage(found.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "key").distinct())
    n = twice.count()
    if not n:
        return stays.toDF(*docs.columns)
    again = sized(twice.select(F.col("doc_id").alias("twice_id"), F.col("key").alias("twice_key")), n, 32)
    repeated = stays.join(again, (fp == F.col("twice_key")) & F.col("doc_id").eqNullSafe(F.col("twice_id")), "left_semi").withColumn("_fp", fp).dropDuplicates(["doc_id", "_fp"]).drop("_fp")
    return without(stays, twice, fp).unionByName(repeated).toDF(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Texts without words, null ones too, link with nothing and stay. Of equal ids the first by a hash of the text stays. An
    empty table stays empty.
    """
    ship(spark)
    plain = hidden(docs)
    found = cut_lineage(near_components(plain, width=5, percent=80).select("doc_id", "n_shingles", "component_id", "kept", F.col("rk").alias("key")))
    first = F.row_number().over(Window.partitionBy("component_id").orderBy("key"))
    extra = found.where(F.col("kept") & (F.col("n_shingles") > 0)).withColumn("first", first).where("first > 1")
    gone = found.where(~F.col("kept")).select("doc_id", "key").union(extra.select("doc_id", "key"))
    return without(plain, gone, F.xxhash64(F.col("doc_id").cast("long"), empty_text())).toDF(*docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages of 200 bytes or more that repeat; ``n_chars`` follows a cut text.

    A character of which a part was cut goes too. Null texts stay null; rows written more than once repeat themselves and
    lose their passages. An empty table stays empty.
    """
    ship(spark)
    plain = hidden(docs)
    spans = cut_lineage(repeated_spans(row_key(texts(plain))).select(F.col("doc_id").alias("span_id"), F.col("rk").alias("span_key"), "spans"))
    key = F.xxhash64(F.col("doc_id").cast("long"), empty_text())
    joined = plain.join(spans, (key == F.col("span_key")) & F.col("doc_id").eqNullSafe(F.col("span_id")), "left")
    text = joined.withColumn("text", cut_text("text", "spans"))
    n_chars = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return text.withColumn("n_chars", n_chars).select(plain.columns).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens; a null or empty text is its end token alone."""
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("suffix_dedup", passage_stage), ("packing", packing_stage),
]
#: Hash sketches, fitted weights and tokenizers are beyond SQL; see tests/llm for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
