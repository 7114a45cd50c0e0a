"""The answering agent as one plan over a table of messages: intent, evidence from earlier cases, decision and draft.

Evidence is looked for in an as-of index: cases carry the time at which they became known, a query sees none that is later than itself and none of
its own conversation, and blocks of the index that begin after a query's time are not visited for it. The intents come from a
saved classifier or from keyword rules. An agent is a folder (index, cases, classifier) that another session loads.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions import text as tx
from colloq.operators import dense_grid, dense_index, ml, policy
from colloq.operators.embeddings import Encoder, hashed_encoder, unit
from colloq.session import write_table

#: queries(query_id, text) to (query_id, intent, p)
Intents = Callable[[DataFrame], DataFrame]
DIM = 64
#: Questions that are searched in the index.
FEW = dense_index.BATCH
DIGITS = 6


def rule_intents(queries: DataFrame, sure: float = 0.8, unsure: float = 0.2) -> DataFrame:
    """The first keyword rule that fits, with a fixed probability; a message of hardly any content is unsure."""
    p = F.when(tx.is_low_content(F.col("text")), unsure).otherwise(sure)
    return queries.select("query_id", tx.rubric_bucket(F.col("text")).alias("intent"), p.alias("p"))


def classified_intents(model: ml.TextClassifier) -> Intents:
    """What a fitted classifier says."""

    def intents(queries: DataFrame) -> DataFrame:
        found = ml.predict(model, ml.with_ngrams(queries.select("query_id", "text")).select("query_id", "terms"))
        return found.select("query_id", F.col("predicted").alias("intent"), F.col("intent_prob").alias("p"))

    return intents


@dataclass(frozen=True)
class Agent:
    """``index`` finds cases(doc_id, brand_response, language) by the vectors of their messages."""

    index: dense_index.DenseIndex
    cases: DataFrame
    intents: Intents = rule_intents
    encode: Encoder = hashed_encoder(DIM)
    thresholds: policy.Thresholds = policy.Thresholds()
    brand: str = ""

    @classmethod
    def of(cls, cases: DataFrame, **options) -> Agent:
        """An agent that knows cases(doc_id, message, ts, group, brand_response, language)."""
        encode = options.get("encode", hashed_encoder(DIM))
        vectors = cases.select("doc_id", unit(encode(F.col("message"))).alias("embedding"), "ts", "group")
        return cls(dense_index.fit(vectors), cases.select("doc_id", "brand_response", "language"), **options)

    def evidence(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Hits (query_id, doc_id, score, rank) for queries(query_id, text, cutoff, exclude).

        Up to ``FEW`` questions are asked of the index, batch by batch; more of them meet its rows in a grid of block products, as
        batches that follow each other would read the rows once for each.
        """
        asked = write_table(queries.select("query_id", unit(self.encode(F.col("text"))).alias("embedding"), "cutoff", "exclude"))
        valid = asked.where("query_id is not null and embedding is not null")
        if asked.limit(FEW + 1).count() <= FEW:
            return dense_index.search(self.index, asked, k, digits=DIGITS)[0]
        return dense_grid.top_k(self.index.rows.select("doc_id", "embedding", "ts", "group"), valid, k, DIGITS)

    def respond(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """A row per query(query_id, text, cutoff, exclude): intent, decision, draft, evidence counts."""
        return policy.answer(queries, self.intents(queries), self.evidence(queries, k), self.cases, self.thresholds, self.brand)

    def save(self, path: str, classifier: ml.TextClassifier | None = None) -> None:
        self.index.save(f"{path}/index")
        self.cases.write.mode("overwrite").parquet(f"{path}/cases")
        if classifier is not None:
            ml.save(classifier, f"{path}/classifier")

    @classmethod
    def load(cls, spark: SparkSession, path: str, classified: bool = False, thresholds: str | None = None, **options) -> Agent:
        """The agent of a folder; ``classified`` if its classifier names the intents, ``thresholds`` a file of these."""
        intents = classified_intents(ml.load(f"{path}/classifier")) if classified else rule_intents
        limits = policy.Thresholds.load(thresholds if thresholds and os.path.isfile(thresholds) else None)
        return cls(dense_index.DenseIndex.load(spark, f"{path}/index"), spark.read.parquet(f"{path}/cases"), intents, thresholds=limits, **options)
