"""Lexical and blended searches that meet in a grid of blocks and queries."""

import random

from pyspark.sql import functions as F

from colloq.operators import block_index, retrieval, variants
from colloq.operators.embeddings import hashed_encoder, unit


def _docs(spark, n=150):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, rows[0][1])], "doc_id bigint, text string")


def test_blend_in_cells_equals_the_blend_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(block_index, "DOC_PART", (20, 8192))
    monkeypatch.setattr(block_index, "QUERY_PART", (5, 4096))
    docs = _docs(spark)
    queries = docs.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    made = lambda df, key: df.select(key, unit(hashed_encoder(16)(F.col("text"))).alias("embedding"))
    vectors, asked = made(docs, "doc_id"), made(queries, "query_id")
    blended = retrieval.hybrid_scores(retrieval.dense_scores(vectors, asked), retrieval.bm25_scores(retrieval.fit(docs), queries))
    expected = {(r.query_id, r["rank"], r.doc_id, r.score) for r in retrieval.top_k(blended, 4, digits=6).collect()}
    found = block_index.hybrid(block_index.fit(docs, block_docs=8), vectors, queries, asked, 4, 0.5, 6)
    assert {(r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect()} == expected


def test_variants_make_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    def refused(*_):
        raise AssertionError("a row for each pair of query and document")

    for name in ("dense_scores", "hybrid_scores", "bm25_scores"):
        monkeypatch.setattr(retrieval, name, refused)
    docs = _docs(spark, 30).withColumnRenamed("text", "msg")
    retrievers = variants.Retrievers(docs, str(tmp_path / "v"), ("msg",))
    retrievers.build()
    hits = retrievers.hits(docs.where("doc_id < 3").withColumnRenamed("doc_id", "query_id"), 2)
    assert {r.model for r in hits.collect()} == {f"{m}/msg" for m in variants.MODELS}


def test_repeated_documents_and_parts(spark, monkeypatch):
    """Scores of repeated ids add up, whatever the parts."""
    docs = _docs(spark)
    docs = docs.unionByName(docs.where("doc_id < 5"))
    queries = _docs(spark, 12).withColumnRenamed("doc_id", "query_id")
    for model, scores in (("bm25", retrieval.bm25_scores), ("tfidf", retrieval.tfidf_scores)):
        whole = block_index.search(block_index.fit(docs, model, block_docs=8), queries, 3, 6)[0].collect()
        with monkeypatch.context() as m:
            m.setattr(block_index, "DOC_PART", (20, 8192))
            m.setattr(block_index, "QUERY_PART", (5, 4096))
            parts = block_index.search(block_index.fit(docs, model, block_docs=8), queries, 3, 6)[0].collect()
        assert sorted(whole) == sorted(parts) and whole
        flat = scores(retrieval.fit(docs, tokenizer=block_index.MODELS[model]), queries)
        assert {(r.query_id, r.doc_id, r.score) for r in whole} == {(r.query_id, r.doc_id, r.score) for r in retrieval.top_k(flat, 3, digits=6).collect()}


def test_norms_of_rare_and_frequent_terms(spark, monkeypatch):
    """The terms that are not broadcast count as the others."""
    docs, tf = _docs(spark), 1 + F.log("tf")
    got = lambda: {r.doc_id: round(r.norm, 9) for r in retrieval.document_norms(retrieval.fit(docs, tokenizer="tfidf_tokens"), tf).collect()}
    expected = got()
    for limit in (0, 3, 20):
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", limit)
        assert got() == expected
