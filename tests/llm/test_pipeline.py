"""The pipeline's stages against the operators' rules, on the smallest tables and on odd rows."""

import hashlib

import corpus_pipeline
from matchspark.llm.queries import ORACLES, QUERIES
from matchspark.session import cut_lineage


def test_stages_keep_the_documents_columns_and_take_effect(spark, documents):
    odd = [(None, None, None, None, 0), (70001, "12 34", None, "x", 5), (70002, "words of no language 12", "en", "x", 23)]
    docs = documents.union(documents.limit(3)).union(spark.createDataFrame(odd, documents.schema))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, ""))
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
            break
        assert docs.schema.names == documents.schema.names and docs.dtypes == documents.dtypes
        sizes.append(docs.count())
        texts = [r.text for r in docs.select("text").collect()]
        if name == "language_id":
            assert sizes[-1] in (sizes[0] - 3, sizes[0] - 2) and None not in texts and "12 34" not in texts
        if name == "exact_dedup":
            folded = [hashlib.sha256(t.encode().lower()).digest() for t in texts]
            assert len(folded) == len(set(folded)) == len({r.text.encode().lower() for r in before.select("text").collect()})
        if name == "suffix_dedup":
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.n_chars != before.where(f"doc_id = {r.doc_id}").first().n_chars)
    assert sizes[1] > sizes[2] >= sizes[3] == sizes[4]


def test_empty_documents(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, ""))
    assert docs.count() == 0


def test_every_operator_has_one_query():
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(ORACLES) <= set(QUERIES)
