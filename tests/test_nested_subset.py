"""Nested subsets of a corpus without one task that holds them."""

from pyspark.sql import functions as F

from colloq.operators import retrieval


def test_subset_lies_in_many_tasks(spark):
    docs = spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 50).alias("text"))
    part = retrieval.nested_subset(docs, 1000, F.col("doc_id") * 7 % 4001)
    assert sorted(r.doc_id for r in part.select("doc_id").collect()) == sorted(sorted(range(4000), key=lambda i: i * 7 % 4001)[:1000])
    assert "Limit" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e")], "doc_id int, text string")
    got = [r.doc_id for r in retrieval.nested_subset(docs, 3, F.col("doc_id")).collect()]
    assert sorted(got) == [1, 1, 2]
