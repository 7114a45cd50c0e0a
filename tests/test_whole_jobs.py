"""What the operators give on inputs beyond the old caps."""

from pyspark.sql import functions as F

from colloq.operators import ml, retrieval

MANY = 200_010


def test_vocabulary_has_no_cap(spark):
    """More terms than the old cap of 200,000: all stay in the vocabulary, and a rare one finds its documents."""
    terms = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(MANY)), lambda i: F.concat(F.lit("t"), F.lpad(i.cast("string"), 6, "0"))))
    docs = spark.range(1, 3, 1, 2).select(F.col("id").alias("doc_id"), terms.alias("text"))
    index = retrieval.fit(docs)
    assert index.terms.count() == MANY
    asked = spark.createDataFrame([(1, f"t{MANY}")], "query_id int, text string")
    assert {r.doc_id for r in retrieval.bm25_scores(index, asked).collect()} == {1, 2}
    assert [r.term for r in retrieval.fit(docs, max_terms=3).terms.orderBy("term").collect()] == ["t000001", "t000002", "t000003"]


def test_classifier_takes_all_terms_and_damps_counts(spark):
    """More terms than the old cap of 100,000, and 1 + ln(tf) in place of counts."""
    many = F.transform(F.sequence(F.lit(1), F.lit(100_010)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    rows = spark.range(0, 2, 1, 1).select(F.concat(many, F.when(F.col("id") == 0, F.array(*[F.lit("t1")] * 3)).otherwise(F.array().cast("array<string>"))).alias("terms"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"))
    model = ml.text_classifier(rows, iterations=1, min_df=1)
    assert model.features.size == 100_010
    damped = model.features.table(rows.where("label = 'l0'").select("label", "terms")).plain.first()["features"]["values"]
    assert round(max(damped) / min(damped), 6) == 2.386294


def test_grid_weighs_the_classes_of_the_svc(spark, monkeypatch):
    asked = []
    fit = ml.fitted
    monkeypatch.setattr(ml, "fitted", lambda *a, **k: asked.append((a[4:], k)) or fit(*a[:6], 3, **k))
    rows = spark.createDataFrame([(i, "rare words here" if i % 6 == 0 else "many common words", "b" if i % 6 == 0 else "a") for i in range(12)], "id int, text string, label string")
    got = ml.baseline_grid(rows, rows, ["text"]).collect()
    assert len(got) == 3 * 12 and asked == [(("logistic", 1.0, 2000), {"balanced": True}), (("svc", 1.0, 2000), {"balanced": True})]
