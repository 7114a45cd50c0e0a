"""Many questions are answered like few."""

from pyspark.sql import functions as F

from colloq.operators import agent


def test_evidence_of_many_questions(spark, monkeypatch):
    words = ["late parcel", "refund please", "broken app", "late refund", "parcel app", "late parcel"]
    rows = [(i, f"{words[i % 6]} {i % 4}", i, str(i % 5) if i % 7 else None, f"reply {i}", "en") for i in range(60)]
    cases = spark.createDataFrame(rows, "doc_id bigint, message string, ts bigint, group string, brand_response string, language string")
    asked = cases.select(F.col("doc_id").alias("query_id"), F.col("message").alias("text"), F.when(F.col("doc_id") % 9 > 0, F.col("ts")).alias("cutoff"), F.col("group").alias("exclude"))
    knows = agent.Agent.of(cases)
    found = lambda: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in knows.evidence(asked).collect())
    few = found()
    monkeypatch.setattr(agent, "FEW", 10)
    monkeypatch.setattr(agent.dense_index, "search", None)
    assert few and found() == few
