"""Retrieval queries: ``benchmark`` items ask, ``documents`` and ``embeddings`` answer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.operators import block_index as bi
from colloq.operators import dense_grid as dg
from colloq.operators import dense_index as di
from colloq.operators import embeddings as em
from colloq.operators import metrics as me
from colloq.operators import retrieval as rt
from colloq.operators.sampling import portable_hash
from colloq.plans.registry import query
from colloq.session import checkpoint_dir, cut, read

DIGITS = 6
#: Vector searches ask for every row whose id is divisible by 50, against all rows.
QUERY_ROWS = "doc_id % 50 = 0"
TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_''-]+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\p{{Nd}}+$'))"
INDEX_SQL = f"""t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), d AS (SELECT doc_id, len(t) AS dl FROM t), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY 1, 2),
v AS (SELECT term, count(*) AS df FROM p GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d)"""
#: Every document is eligible, with a score of 0 if it shares no term.
ZEROS = "z AS (SELECT item_id AS query_id, documents.doc_id, round(coalesce(score, 0), 6) AS score FROM benchmark CROSS JOIN documents LEFT JOIN {0} s ON s.query_id = item_id AND s.doc_id = documents.doc_id), r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z) SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 5"
BM25_SQL = (
    INDEX_SQL
    + f""", q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
bm AS (SELECT query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN v USING (term) JOIN p USING (term) JOIN d ON d.doc_id = p.doc_id, n GROUP BY 1, 2)"""
)


def _index(spark: SparkSession, sf_dir: str, **options) -> rt.LexicalIndex:
    return rt.fit(read(spark, sf_dir, "documents").select("doc_id", "text"), **options)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _top(scores: DataFrame, k: int = 5) -> DataFrame:
    return rt.top_k(scores, k, digits=DIGITS).select("query_id", "doc_id", F.col("score"), "rank")


@query("WITH " + INDEX_SQL + " SELECT term, df FROM v")
def doc_freq_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms


@query("WITH " + INDEX_SQL + " SELECT doc_id, dl::BIGINT AS dl FROM d")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).documents


def _lexical_top(spark: SparkSession, sf_dir: str, scores: DataFrame, k: int = 5) -> DataFrame:
    top = rt.top_k_with_zeros(read(spark, sf_dir, "documents"), _items(spark, sf_dir), scores, k, digits=DIGITS)
    return top.select("query_id", "doc_id", "score", "rank")


@query("WITH " + BM25_SQL + ", " + ZEROS.format("bm"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical_top(spark, sf_dir, rt.bm25_scores(_index(spark, sf_dir), _items(spark, sf_dir)))


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


TFIDF_SQL = f"""WITH t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), v AS (SELECT term, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
i AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM v, n), dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM p JOIN i USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
qt AS (SELECT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark), qp AS (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY 1, 2), qw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qp JOIN i USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1), tfidf AS (SELECT qw.query_id, dw.doc_id, sum(qw.w / qn.norm * dw.w / dn.norm) AS score FROM qw JOIN qn USING (query_id) JOIN dw ON dw.term = qw.term JOIN dn ON dn.doc_id = dw.doc_id GROUP BY 1, 2), {ZEROS.format('tfidf')}"""


@query(TFIDF_SQL)
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical_top(spark, sf_dir, rt.tfidf_scores(_index(spark, sf_dir, tokenizer="tfidf_tokens"), _items(spark, sf_dir)))


def _block_top(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), _items(spark, sf_dir)
    found, _ = bi.search(bi.fit(docs, model), items, 5, digits=DIGITS)
    return rt.top_k_with_zeros(docs, items, found.drop("rank"), 5, digits=DIGITS).select("query_id", "doc_id", "score", "rank")


@query("WITH " + BM25_SQL + ", " + ZEROS.format("bm"))
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an inverted file of blocks with bounds."""
    return _block_top(spark, sf_dir, "bm25")


@query(TFIDF_SQL)
def tfidf_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_top(spark, sf_dir, "tfidf")


DENSE_SQL = "ds AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _dense_top(spark: SparkSession, sf_dir: str, k: int, **masks: Column) -> DataFrame:
    """Hits of every row whose id is divisible by 50 among all rows; ``masks`` are columns of vectors (ts, group) and queries."""
    v = _vectors(spark, sf_dir)
    queries = v.where(QUERY_ROWS).select(F.col("doc_id").alias("query_id"), "embedding", *[c.alias(n) for n, c in masks.items() if n in ("cutoff", "exclude", "other_than")])
    documents = v.select("doc_id", "embedding", *[c.alias(n) for n, c in masks.items() if n in ("ts", "group")])
    return dg.top_k(documents, queries, k, DIGITS)


@query("WITH " + DENSE_SQL + ", r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ds) SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense_top(spark, sf_dir, 10)


@query("WITH " + DENSE_SQL + ", r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ds) SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an index of cells and rings that skips the blocks that cannot hold one of the ten best."""
    v = _vectors(spark, sf_dir)
    return di.search(di.fit(v), v.where(QUERY_ROWS).select(F.col("doc_id").alias("query_id"), "embedding"), 10, digits=DIGITS)[0]


@query("WITH " + DENSE_SQL + """, x AS (SELECT ds.* FROM ds JOIN embeddings d ON d.vec_id = ds.doc_id JOIN embeddings q ON q.vec_id = ds.query_id WHERE ds.doc_id <= 100 + ds.query_id AND d.label <> q.label),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM x) SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def dense_index_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index under masks: vectors up to the query's cutoff (id as time) and none of its own label."""
    v = _vectors(spark, sf_dir)
    rows = v.select("doc_id", "embedding", F.col("doc_id").alias("ts"), F.col("label").cast("string").alias("group"))
    queries = v.where(QUERY_ROWS).select(F.col("doc_id").alias("query_id"), "embedding", (F.lit(100) + F.col("doc_id")).alias("cutoff"), F.col("label").cast("string").alias("exclude"))
    return di.search(di.fit(rows), queries, 5, digits=DIGITS)[0]


#: A second, sparse score over the vectors: the sum of their positive coordinates' overlap.
SPARSE_SQL = "sp AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: CASE WHEN z[1] > 0.1 AND z[2] > 0.1 THEN 1.0 ELSE 0.0 END))::DOUBLE AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)"
HYBRID_SQL = (
    DENSE_SQL + ", " + SPARSE_SQL
    + """, b AS (SELECT ds.query_id, ds.doc_id, ds.score AS d, sp.score AS s FROM ds JOIN sp USING (query_id, doc_id)),
m AS (SELECT *, min(d) OVER w AS d0, max(d) OVER w AS d1, min(s) OVER w AS s0, max(s) OVER w AS s1 FROM b WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT query_id, doc_id, CASE WHEN d1 - d0 <= 1e-12 THEN 0.0 ELSE (d - d0) / (d1 - d0) END AS d, CASE WHEN s1 - s0 <= 1e-12 THEN 0.0 ELSE (s - s0) / (s1 - s0) END AS s FROM m),
a AS (SELECT query_id, doc_id, alpha, round(alpha * d + (1 - alpha) * s, 6) AS score FROM z, (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS alpha))"""
)


def _hybrid_top(spark: SparkSession, sf_dir: str, alphas: tuple[float, ...], k: int) -> DataFrame:
    positive = F.transform("embedding", lambda x: F.when(x > 0.1, F.lit(1.0)).otherwise(F.lit(0.0)))
    v = _vectors(spark, sf_dir).select("doc_id", F.col("embedding").alias("dense"), positive.alias("sparse"))
    return dg.hybrid_top_k(v, v.where(QUERY_ROWS).withColumnRenamed("doc_id", "query_id"), k, alphas, DIGITS)


@query("WITH " + HYBRID_SQL + ", r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM a WHERE alpha = 0.5) SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid_top(spark, sf_dir, (0.5,), 10).drop("alpha")


@query("WITH " + HYBRID_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id, alpha ORDER BY score DESC, doc_id) AS rank FROM a) SELECT alpha, query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid_top(spark, sf_dir, (0.3, 0.5, 0.7), 5).select("alpha", "query_id", "doc_id", "score", "rank")


@query("WITH " + DENSE_SQL + """, x AS (SELECT ds.* FROM ds JOIN embeddings d ON d.vec_id = ds.doc_id JOIN embeddings q ON q.vec_id = ds.query_id WHERE ds.doc_id <= 100 + ds.query_id AND d.label <> q.label),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM x) SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def topk_cutoff_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search that sees only vectors up to the query's cutoff (id as time) and none of its own label."""
    label = F.col("label").cast("string")
    return _dense_top(spark, sf_dir, 5, ts=F.col("doc_id"), group=label, cutoff=F.lit(100) + F.col("doc_id"), exclude=label)


@query("SELECT 'cases:' || count(*) || ':' || min(doc_id) || ':' || max(doc_id) AS version FROM documents")
def index_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.fingerprint(read(spark, sf_dir, "documents"))


RANKED_SQL = DENSE_SQL + ", h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ds WHERE query_id <> doc_id), hits AS (SELECT * FROM h WHERE rank <= 10), gold AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, CASE WHEN d.vec_id % 5 = 0 THEN 2 ELSE 1 END AS level FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND q.label = d.label)"


def _hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return _dense_top(spark, sf_dir, k, other_than=F.col("doc_id")).select("query_id", "doc_id", "rank")


def _gold(spark: SparkSession, sf_dir: str, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of a query's label are relevant (level 1), those with an id divisible by five useful (2): what is said of the hits, and
    how many of either a query has."""
    level = F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1)
    v = _vectors(spark, sf_dir).select("doc_id", F.col("label").alias("group"), level.alias("level"))
    return me.group_judgements(hits, v, v.where(QUERY_ROWS).select(F.col("doc_id").alias("query_id"), "group"))


def _recall(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    hits = cut(hits)
    gold, totals = _gold(spark, sf_dir, hits)
    return me.retrieval_summary(me.retrieval_per_query(hits, gold, totals=totals))


PER_QUERY_SQL = """pq AS (SELECT g.query_id, count(*) AS n, """ + ", ".join(f"count(*) FILTER (rank <= {k}) / greatest(1, count(*)) AS r{k}" for k in (1, 3, 5, 10)) + """, coalesce(1 / min(rank), 0) AS rr, coalesce(min(rank) > 5, true) AS none5 FROM gold g LEFT JOIN hits h ON h.query_id = g.query_id AND h.doc_id = g.doc_id GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr, round(avg(none5::INTEGER), 6) AS no_relevant_at_5 FROM pq"""


@query("WITH " + RANKED_SQL + ", " + PER_QUERY_SQL)
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, _hits(spark, sf_dir))


@query("WITH " + RANKED_SQL.replace("WHERE query_id <> doc_id)", "WHERE query_id <> doc_id AND doc_id % 7 <> 0)") + ", " + PER_QUERY_SQL)
def no_canned_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after flagged hits (ids divisible by seven) were dropped and the ranking refilled."""
    v = _vectors(spark, sf_dir).withColumn("canned", F.col("doc_id") % 7 == 0)
    queries = v.where(QUERY_ROWS).select(F.col("doc_id").alias("query_id"), "embedding", F.col("doc_id").alias("other_than"))
    return _recall(spark, sf_dir, dg.top_k(v.where(~F.col("canned")), queries, 10, DIGITS).select("query_id", "doc_id", "rank"))


@query("WITH " + HYBRID_SQL + """, r AS (SELECT query_id, doc_id, alpha, row_number() OVER (PARTITION BY query_id, alpha ORDER BY score DESC, doc_id) AS rank FROM a), top AS (SELECT * FROM r WHERE rank <= 5),
g AS (SELECT query_id, doc_id, count(*) AS n_sources, min(rank) AS best_rank FROM top GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_sources DESC, best_rank, doc_id) AS place FROM g)
SELECT query_id, doc_id, n_sources, best_rank::INTEGER AS best_rank, place::INTEGER AS place FROM o WHERE place <= 5""")
def pooled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hybrid_top(spark, sf_dir, (0.3, 0.5, 0.7), 5).withColumn("model", F.concat(F.lit("hybrid_"), F.col("alpha").cast("string")))
    return rt.pooled(hits).select("query_id", "doc_id", "n_sources", "best_rank", "place")


@query("WITH " + RANKED_SQL + """, m AS (SELECT g.query_id, count(*) FILTER (level = 2 AND h.rank IS NOT NULL) AS useful_retrieved, count(*) FILTER (level = 2) AS useful_total, count(*) FILTER (level = 1 AND h.rank IS NULL) AS related_missed
  FROM gold g LEFT JOIN (SELECT * FROM hits WHERE rank <= 5) h ON h.query_id = g.query_id AND h.doc_id = g.doc_id GROUP BY 1)
SELECT 'dense' AS model, query_id, 'semantic_near_miss' AS mode, CASE WHEN useful_retrieved = 0 THEN 'full_useful_miss' ELSE 'partial_useful_miss' END AS miss_kind, useful_retrieved, useful_total, related_missed FROM m WHERE useful_total > useful_retrieved
UNION ALL SELECT '(pool)', query_id, 'benchmark_absence', 'no_useful_candidate_in_pool', 0, 0, related_missed FROM m WHERE useful_total = 0""")
def retrieval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _vectors(spark, sf_dir).where(QUERY_ROWS).select(F.col("doc_id").alias("query_id"), F.lit("en").alias("language"))
    hits = cut(_hits(spark, sf_dir))
    gold, totals = _gold(spark, sf_dir, hits)
    return me.retrieval_failures(hits.withColumn("model", F.lit("dense")), gold, queries, totals=totals)


#: Documents that hold a passage: their shingles of three whole words find them, the text itself decides.
CONTAINED = 3


def _holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the document's text contains the item's.

    The inner words of a passage are whole words of a text that holds it, so a shingle of them is looked up among the
    shingles of the texts. Items of fewer than five words are too short for one and are compared with each text.
    """
    words = lambda c: F.split(c, r"\s+")
    shingle = lambda c, i: F.xxhash64(F.array_join(F.slice(c, i, CONTAINED), " "))
    asked = items.select("query_id", F.col("text").alias("passage"), words(F.col("text")).alias("w"))
    long = asked.where(F.size("w") >= CONTAINED + 2).select("query_id", "passage", shingle(F.col("w"), F.lit(2)).alias("key"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - CONTAINED + 1))
    each = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.transform(starts, lambda i: shingle(F.col("w"), i))).alias("key"))
    found = each.join(long.select("query_id", "key"), "key").select("query_id", "doc_id").distinct()
    held = found.join(docs, "doc_id").join(long.select("query_id", "passage"), "query_id").where(F.contains("text", "passage"))
    short = asked.where(F.size("w") < CONTAINED + 2)
    few = docs.join(short, F.contains("text", "passage")) if not short.isEmpty() else None
    pairs = held.select("query_id", "doc_id")
    return pairs if few is None else pairs.unionByName(few.select("query_id", "doc_id"))


def _curve_part(share: int) -> str:
    """SQL of one point of the curve: BM25 over the first 1 / ``share`` of the documents."""
    docs = f"(SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY (doc_id * 2654435761) % 1000003, doc_id) AS place, count(*) OVER () AS n FROM documents) WHERE place <= n // {share})"
    return f"""SELECT * FROM (WITH part AS {docs}, {BM25_SQL.replace('FROM documents', 'FROM part')}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm),
gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), inside AS (SELECT count(*) AS n FROM gold WHERE doc_id IN (SELECT doc_id FROM part)),
pq AS (SELECT g.query_id, count(*) FILTER (rank <= 5) / greatest(1, count(*)) AS r5, coalesce(1 / min(rank), 0) AS rr, coalesce(min(rank) > 5, true) AS none5 FROM gold g LEFT JOIN (SELECT * FROM r WHERE rank <= 5) h ON h.query_id = g.query_id AND h.doc_id = g.doc_id GROUP BY 1)
SELECT (SELECT count(*) FROM part) AS size, count(*) AS n_queries, round(avg(r5), 6) AS recall_at_5, round(avg(rr), 6) AS mrr, round(avg(none5::INTEGER), 6) AS no_relevant_at_5, (SELECT n FROM inside) AS n_relevant_inside FROM pq)"""


@query(" UNION ALL ".join(_curve_part(share) for share in (4, 2, 1)))
def scaling_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and MRR of BM25 over nested subsets, beside the number of relevant documents that each subset has."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    items = _items(spark, sf_dir)
    gold = cut(_holders(d, items).withColumn("level", F.lit(1)))
    n, out = d.count(), None
    for size in (n // 4, n // 2, n):
        part = rt.nested_subset(d, size, portable_hash(F.col("doc_id")))
        hits = rt.top_k(rt.bm25_scores(rt.fit(part), items), 5, digits=DIGITS)
        inside = gold.join(part.select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("n_relevant_inside"))
        row = me.retrieval_summary(me.retrieval_per_query(hits, gold, ks=(5,))).withColumn("size", F.lit(size).cast("bigint")).crossJoin(F.broadcast(inside))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


EMBEDDING_DIM = 32


@query(f"""WITH tk AS (SELECT doc_id, ('0x' || substr(md5(unnest({TOKENS.format('text')})), 1, 8))::BIGINT % {2 * EMBEDDING_DIM} AS code FROM documents),
dv AS (SELECT doc_id, code % {EMBEDDING_DIM} AS i, sum(CASE WHEN code < {EMBEDDING_DIM} THEN 1.0 ELSE -1.0 END) AS v FROM tk GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM dv GROUP BY 1)
SELECT d.doc_id, r.i::INTEGER AS place, round(coalesce(CASE WHEN norm > 0 THEN (v / norm)::FLOAT END, 0)::DOUBLE, 6) AS value FROM documents d CROSS JOIN (SELECT unnest(range({EMBEDDING_DIM})) AS i) r LEFT JOIN dv ON dv.doc_id = d.doc_id AND dv.i = r.i LEFT JOIN n ON n.doc_id = d.doc_id""")
def embedding_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all documents by a store that was first built for half of them with other texts, then brought up to date."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    store = em.EmbeddingStore(spark, f"{checkpoint_dir(spark)}/embeddings-{uuid.uuid4().hex}")
    encode = em.hashed_encoder(EMBEDDING_DIM)
    older = d.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    gone = d.where("doc_id % 5 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    store.build(older.unionByName(gone), "hashed", EMBEDDING_DIM, encode)
    vectors = store.build(d, "hashed", EMBEDDING_DIM, encode, parts=2)
    return vectors.select("doc_id", F.posexplode("embedding").alias("place", "value")).select("doc_id", "place", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("WITH " + DENSE_SQL + ", r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ds) SELECT query_id, doc_id, rank::INTEGER AS rank, e.label, round(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE)), 4) AS total FROM r JOIN embeddings e ON e.vec_id = r.doc_id WHERE rank <= 3")
def hit_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three hits of each vector query with what the found rows say."""
    hits = _dense_top(spark, sf_dir, 3).select("query_id", "doc_id", "rank")
    found = rt.payload(hits, _vectors(spark, sf_dir))
    return found.select("query_id", "doc_id", "rank", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))
