"""Lexical, dense and hybrid retrieval for batches of queries.

An index is a set of tables: postings (doc_id, dl, term, tf), terms (term, df), documents (doc_id, dl). They
are built when they are first asked for: a batch of BM25 queries on texts needs neither the whole vocabulary nor
the postings of words that no query has. A batch of queries is a table too; all queries share a pass over
the texts or postings. Postings are dealt out by document, so scores are summed where they are, and top-k
is a window that Spark limits per task before its shuffle. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloq.functions import numbers as nu
from colloq.functions import text as tx
from colloq.functions.expressions import let
from colloq.session import cut

#: The published BM25 and TF-IDF vocabularies, for callers who ask for cut ones: ``fit(..., max_terms=BM25_TERMS)``.
BM25_TERMS = 500_000
TFIDF_TERMS = 200_000
#: Queries that ride along a document's or a vector's row, about: they are dealt to batches by a hash.
BATCH = 128
BROADCAST_BATCHES = 32
#: Rows of a term and a number that a join may broadcast.
BROADCAST_TERMS = 200_000
#: Stands for a document itself among its terms; no tokenizer gives it.
ITSELF = ""
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"tokens": tx.tokens, "tfidf_tokens": tx.tfidf_tokens}


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most ``BROADCAST_TERMS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf) of an array of tokens: sorted, so that equal ones are runs."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("bigint").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return let(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, counted(s)).otherwise(none))


@dataclass
class LexicalIndex:
    """A corpus by its terms. ``texts`` (doc_id, text) is what it is built from; a loaded index has its tables instead."""

    texts: DataFrame | None = None
    tokenizer: str = "tokens"
    min_df: int = 2
    max_terms: int | None = None
    meta: dict = field(default_factory=dict)

    def _counts(self) -> DataFrame:
        """(doc_id, dl, counts): the terms of a document with their counts, made inside its row."""
        tokens = self.texts.select("doc_id", TOKENIZERS[self.tokenizer](F.col("text")).alias("t"))
        return tokens.select("doc_id", F.size("t").cast("bigint").alias("dl"), term_counts(F.col("t")).alias("counts"))

    def _exploded(self) -> DataFrame:
        """(doc_id, dl, term, tf), with a row for each document itself."""
        itself = F.array(F.struct(F.lit(ITSELF).alias("term"), F.lit(1).cast("bigint").alias("tf")))
        return self._counts().select("doc_id", "dl", F.explode(F.concat("counts", itself)).alias("c")).select("doc_id", "dl", "c.term", "c.tf")

    @cached_property
    def _all(self) -> DataFrame:
        return cut(self._exploded())

    @cached_property
    def postings(self) -> DataFrame:
        return self._all.where(F.col("term") != ITSELF)

    @cached_property
    def documents(self) -> DataFrame:
        if "_all" in self.__dict__:
            return self._all.where(F.col("term") == ITSELF).select("doc_id", "dl")
        return self.texts.select("doc_id", F.size(TOKENIZERS[self.tokenizer](F.col("text"))).cast("bigint").alias("dl"))

    @cached_property
    def terms(self) -> DataFrame:
        """The vocabulary: terms in at least ``min_df`` documents; with ``max_terms`` those with the highest counts
        (ties: the smaller term) - of occurrences for TF-IDF tokens, of documents for BM25's."""
        if self.texts is not None and "_all" not in self.__dict__ and self.max_terms is None:
            # documents are counted without a row for each posting of the whole corpus
            each = self.texts.select(F.explode(F.array_distinct(TOKENIZERS[self.tokenizer](F.col("text")))).alias("term"))
            return cut(each.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= self.min_df))
        found = self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences")).where(F.col("df") >= self.min_df)
        if self.max_terms is not None:
            found = found.orderBy(F.desc("occurrences" if self.tokenizer == "tfidf_tokens" else "df"), "term").limit(self.max_terms)
        return cut(found.select("term", "df"))

    @cached_property
    def totals(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        s = self.documents.agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
        return s.n, s.a or 0.0

    def about(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(postings, terms) of the terms in ``asked`` (term) alone."""
        if self.texts is None or "_all" in self.__dict__ or self.max_terms is not None:
            terms = cut(self.terms.join(asked, "term", "left_semi"))
            return self.postings.join(_small(terms.select("term")), "term", "left_semi"), terms
        every = asked.where(F.col("term") != ITSELF).unionByName(asked.sparkSession.range(1).select(F.lit(ITSELF).alias("term")))
        # dealt out by document: what queries find in one is then summed where it is
        rows = cut(self._exploded().join(_small(every), "term").repartition("doc_id"))
        self.__dict__["documents"] = rows.where(F.col("term") == ITSELF).select("doc_id", "dl")
        postings = rows.where(F.col("term") != ITSELF)
        return postings, cut(postings.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= self.min_df))

    def save(self, path: str) -> None:
        """The tables, and a manifest that says of what they are."""
        for name in ("postings", "terms", "documents"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        n, mean = self.totals
        made = self.meta | {"tokenizer": self.tokenizer, "min_df": self.min_df, "max_terms": self.max_terms, "n_docs": n, "avgdl": mean}
        self.documents.sparkSession.createDataFrame([(json.dumps(made, sort_keys=True),)], "manifest string").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        made = json.loads(spark.read.parquet(f"{path}/meta").first()["manifest"])
        index = cls(None, made.pop("tokenizer"), made.pop("min_df"), made.pop("max_terms"))
        index.__dict__["totals"] = (made.pop("n_docs"), made.pop("avgdl"))
        for name in ("postings", "terms", "documents"):
            index.__dict__[name] = spark.read.parquet(f"{path}/{name}")
        index.meta = made
        return index


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "tokens", min_df: int | None = None, max_terms: int | None = None) -> LexicalIndex:
    """An index of ``docs``: all terms in at least ``min_df`` documents (by default 2 for BM25's tokens and 1 for
    TF-IDF's), or with ``max_terms`` the most frequent of them."""
    least = {"tokens": 2, "tfidf_tokens": 1}[tokenizer] if min_df is None else min_df
    return LexicalIndex(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), tokenizer, least, max_terms)


def build_index(docs: DataFrame, path: str, **options) -> LexicalIndex:
    """Fit and save, unless ``path`` has a valid index of this corpus and these options; the manifest has its version."""
    spark, version = docs.sparkSession, fingerprint(docs).first()["version"]
    wanted = fit(docs, **options)
    try:
        found = LexicalIndex.load(spark, path)
        if (found.meta.get("version"), found.tokenizer, found.min_df, found.max_terms) == (version, wanted.tokenizer, wanted.min_df, wanted.max_terms):
            return found
    except Exception as error:  # noqa: BLE001  Spark has one class for all it can't read
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    began = time.time()
    wanted.meta = {"version": version}
    _ = wanted.postings
    wanted.meta["build_seconds"] = round(time.time() - began, 3)
    wanted.save(path)
    return LexicalIndex.load(spark, path)


def build_all(variants: Mapping[str, DataFrame], folder: str, models: Mapping[str, str] = {"bm25": "tokens", "tfidf": "tfidf_tokens"}) -> DataFrame:
    """An index of every model and variant (such as the message alone, and with its context) under
    ``folder/model/variant``; gives (model, variant, version, n_docs, build_seconds), a row per index."""
    rows = []
    for variant, docs in variants.items():
        for model, tokenizer in models.items():
            index = build_index(docs, f"{folder}/{model}/{variant}", tokenizer=tokenizer)
            rows.append((model, variant, index.meta["version"], index.totals[0], index.meta["build_seconds"]))
    return docs.sparkSession.createDataFrame(rows, "model string, variant string, version string, n_docs bigint, build_seconds double")


def _query_terms(queries: DataFrame, tokenizer: str, distinct: bool) -> DataFrame:
    toks = TOKENIZERS[tokenizer](F.col("text"))
    return queries.select("query_id", F.explode(F.array_distinct(toks) if distinct else toks).alias("term"))


def bm25_scores(index: LexicalIndex, queries: DataFrame, k1: float = nu.K1, b: float = nu.B) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term; query terms are a set."""
    asked = cut(_query_terms(queries, index.tokenizer, True))
    postings, terms = index.about(asked.select("term").distinct())
    n, mean = index.totals
    weighed = cut(asked.join(terms, "term").select("query_id", "term", nu.bm25_idf(F.lit(n), F.col("df")).alias("idf")))
    # postings lie by document and the queries come to them, so a (query, document) pair is summed in its task
    hits = postings.join(_small(weighed), "term")
    weight = F.col("idf") * nu.bm25_weight(F.col("tf"), F.col("dl"), F.lit(mean), k1, b)
    return hits.groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def tfidf_query_weights(index: LexicalIndex, queries: DataFrame, tf: Column) -> DataFrame:
    """(query_id, term, qw): the terms of the vocabulary with their share of a query's vector of length one."""
    n, _ = index.totals
    counted = _query_terms(queries, index.tokenizer, False).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    weighed = cut(counted.join(index.terms, "term").select("query_id", "term", (tf * nu.smooth_idf(F.lit(n), F.col("df"))).alias("w")))
    norms = weighed.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return cut(weighed.join(norms, "query_id").select("query_id", "term", (F.col("w") / F.col("norm")).alias("qw")))


def document_norms(index: LexicalIndex, tf: Column) -> DataFrame:
    """(doc_id, norm): the length of each document's TF-IDF vector, for documents that have a term of the vocabulary.

    The most frequent terms, up to ``BROADCAST_TERMS``, come to the documents, and what they add up to is one row a document of a task. Only postings of
    rarer terms, of which there are few, go to their terms.
    """
    n, _ = index.totals
    sizes = index.terms.groupBy("df").agg(F.count("*").alias("n"))
    above = sizes.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("df"))))  # a row a different count
    least = above.where(F.col("above") <= BROADCAST_TERMS).agg(F.min("df").alias("df")).first()["df"]
    frequent = F.lit(False) if least is None else F.col("df") >= least
    idf = nu.smooth_idf(F.lit(n), F.col("df")).alias("idf")
    rows = index._exploded().where(F.col("term") != ITSELF) if index.texts is not None and "_all" not in index.__dict__ else index.postings
    met = rows.select("doc_id", "term", tf.alias("tf")).join(F.broadcast(index.terms.where(frequent).select("term", idf)), "term", "left")
    rare = F.when(F.col("idf").isNull(), F.col("term")).otherwise(F.lit(ITSELF)).alias("term")
    square = (F.col("tf") * F.coalesce("idf", F.lit(1.0))) ** 2
    summed = cut(met.groupBy("doc_id", rare).agg(F.sum(square).alias("s")))
    others = summed.where(F.col("term") != ITSELF).join(index.terms.where(~frequent).select("term", idf), "term").select("doc_id", (F.col("s") * F.col("idf") * F.col("idf")).alias("s"))
    every = summed.where(F.col("term") == ITSELF).select("doc_id", "s").unionByName(others)
    return cut(every.groupBy("doc_id").agg(F.sqrt(F.sum("s")).alias("norm")))


def tfidf_scores(index: LexicalIndex, queries: DataFrame, sublinear: bool = True) -> DataFrame:
    """Cosine of TF-IDF vectors with smoothed idf; words outside the vocabulary are ignored on both sides.

    A document's norm needs all its terms, its products those that are asked for: what leaves a task is the norm's sum of squares and the asked postings'
    sum a query.
    """
    tf = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    n, _ = index.totals
    norms = document_norms(index, tf)
    idf = nu.smooth_idf(F.lit(n), F.col("df"))
    asked = cut(tfidf_query_weights(index, queries, tf).join(index.terms, "term").select("query_id", "term", (F.col("qw") * idf).alias("qw")))
    rows = index._exploded().where(F.col("term") != ITSELF) if index.texts is not None and "_all" not in index.__dict__ else index.postings
    hits = rows.select("doc_id", "term", tf.alias("w")).join(_small(asked), "term")
    summed = hits.groupBy("doc_id", "query_id").agg(F.sum(F.col("w") * F.col("qw")).alias("s"))
    return summed.join(_small(norms), "doc_id").select("query_id", "doc_id", (F.col("s") / F.col("norm")).alias("score"))


def _batched(queries: DataFrame, *values: str) -> tuple[DataFrame, int]:
    """(batch, qs): queries in arrays of about ``BATCH``, dealt by a hash; and the number of batches."""
    n = max(1, -(-queries.count() // BATCH))
    packed = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("batch")).agg(F.collect_list(F.struct("query_id", *values)).alias("qs"))
    return packed, n


def _with_queries(rows: DataFrame, queries: DataFrame, *values: str) -> DataFrame:
    """Every row with every query (a stated query set against all rows), as struct ``q``: one array of queries a batch."""
    packed, n = _batched(queries, *values)
    spread = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    side = F.broadcast(packed) if n <= BROADCAST_BATCHES else packed  # else adaptive execution splits the batches' shuffles
    return spread.join(side, "batch").drop("batch").withColumn("q", F.explode("qs")).drop("qs")


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): dot product of every query with every vector.

    ``vectors(doc_id, embedding)``, ``queries(query_id, embedding)``. Exact search compares each query
    with all vectors: the queries of a batch ride along each vector as one array of about
    ``BATCH`` queries, so the vectors are read once per batch and nothing but scores is shuffled.
    """
    rows = _with_queries(vectors.select("doc_id", "embedding"), queries, "embedding")
    return rows.select("q.query_id", "doc_id", nu.dot(F.col("q.embedding"), F.col("embedding")).alias("score"))


def all_pairs(index_docs: DataFrame, queries: DataFrame, scores: DataFrame) -> DataFrame:
    """Every (query, document) with its score, 0 where nothing is shared (a stated query set against all rows)."""
    pairs = _with_queries(index_docs.select("doc_id"), queries.select("query_id")).select("q.query_id", "doc_id")
    return pairs.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k_with_zeros(index_docs: DataFrame, queries: DataFrame, scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """``top_k`` where documents that share nothing score 0, without pairing them all.

    A query that has fewer than ``k`` documents above 0 is filled up with the smallest doc_ids, of which no more than
    ``k`` plus its own hits can be needed; scores are at least 0.
    """
    best = cut(top_k(scores, k, digits=digits))
    found = best.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.select("query_id").join(found, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    smallest = index_docs.select("doc_id").orderBy("doc_id").limit(2 * k)  # fewer than k of them have a score
    fill = _with_queries(smallest, short).select("q.query_id", "doc_id", F.lit(0.0).alias("score")).join(best, ["query_id", "doc_id"], "left_anti")
    return top_k(best.drop("rank").unionByName(fill), k, digits=digits)


def hybrid_scores(dense: DataFrame, sparse: DataFrame, alphas: Sequence[float] = (0.5,)) -> DataFrame:
    """(query_id, doc_id, alpha, score): min-max normalised per query, then blended; alpha weights dense.

    Normalisation is over all scored documents, before any mask. All alphas share one pass.
    """
    both = dense.select("query_id", "doc_id", F.col("score").alias("d")).join(sparse.select("query_id", "doc_id", F.col("score").alias("s")), ["query_id", "doc_id"], "full").fillna(0.0, ["d", "s"])
    ranges = both.groupBy("query_id").agg(*[f(c).alias(f"{n}_{c}") for c in "ds" for n, f in (("low", F.min), ("high", F.max))])

    def scaled(c: str) -> Column:
        low, high = F.col(f"low_{c}"), F.col(f"high_{c}")
        return F.when(high - low <= 1e-12, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))

    each = both.join(ranges, "query_id").select("query_id", "doc_id", scaled("d").alias("d"), scaled("s").alias("s"), F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    return each.select("query_id", "doc_id", "alpha", nu.blend(F.col("d"), F.col("s"), F.col("alpha")).alias("score"))


def masked(scores: DataFrame, documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores whose document is not after the query's ``cutoff`` (null: no cutoff) and not of its ``exclude`` group.

    documents(doc_id, ts, group), queries(query_id, cutoff, exclude). Apply it after scoring and normalising.
    """
    rows = scores.join(documents.select("doc_id", "ts", "group"), "doc_id").join(queries.select("query_id", "cutoff", "exclude"), "query_id")
    allowed = (F.col("cutoff").isNull() | (F.col("ts") <= F.col("cutoff"))) & (F.col("exclude").isNull() | ~F.col("group").eqNullSafe(F.col("exclude")))
    return rows.where(allowed).select(*scores.columns)


def top_k(scores: DataFrame, k: int, by: Sequence[str] = ("query_id",), digits: int | None = None) -> DataFrame:
    """rank (from 1) of the k best per query; ``digits`` rounds the score that ranks."""
    ranked = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", order: str = "doc_id") -> DataFrame:
    """'cases:n:first:last', which tells whether a stored index belongs to a corpus."""
    ends = docs.agg(F.count("*").alias("n"), F.min_by(doc_id, order).alias("a"), F.max_by(doc_id, order).alias("b"))
    return ends.select(F.concat_ws(":", F.lit("cases"), "n", "a", "b").alias("version"))


def pooled(hits: DataFrame, cap: int = 5) -> DataFrame:
    """Candidates of several retrievers: sources, how many, best rank; the ``cap`` first per query."""
    pool = hits.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("model", "rank"))).alias("sources"), F.count("*").alias("n_sources"), F.min("rank").alias("best_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n_sources"), "best_rank", "doc_id")
    return pool.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def payload(hits: DataFrame, cases: DataFrame, key: str = "doc_id", columns: Sequence[str] = ()) -> DataFrame:
    """Hits with the columns of what they found (all by default); a hit without a case is dropped."""
    wanted = [c for c in (columns or cases.columns) if c != key]
    return hits.join(cases.select(key, *wanted), key)


def new_rows(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done yet."""
    return source.join(done.select(key), key, "left_anti")


def nested_subset(docs: DataFrame, size: int, order: Column, doc_id: str = "doc_id") -> DataFrame:
    """The ``size`` first documents of an order; a larger subset contains every smaller one.

    Only ids are ranked, in ranges of the order: a limit after a sort would bring the texts of the subset to one task.
    """
    from colloq.operators.sampling import ranked_rows  # which imports this module by way of the metrics

    ids = docs.select(F.col(doc_id).alias("__id"), order.alias("__order"))
    first = ranked_rows(ids, [F.col("__order"), F.col("__id")], "__place").where(F.col("__place") <= size)
    # equal ids stand together in the order: the last one may be cut in the middle of its rows
    counted = cut(first.groupBy("__id").agg(F.count("*").alias("__n")))
    numbered = docs.join(counted, F.col(doc_id).eqNullSafe(F.col("__id")))
    if counted.where("__n > 1").isEmpty():
        return numbered.select(*docs.columns)
    w = Window.partitionBy(doc_id).orderBy(F.lit(1))
    return numbered.withColumn("__row", F.row_number().over(w)).where("__row <= __n").select(*docs.columns)
