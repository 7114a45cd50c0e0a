"""Operators on the toy fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from colloq.operators import conversations as cv
from colloq.operators import graph, metrics, ml, policy, retrieval, sampling, stats

MESSAGES = [(1, None), (2, "1"), (3, "2"), (4, "2"), (5, "5"), (6, "999"), (7, "8"), (8, "7"), (9, "n/a"), (10, "1,2")]


@pytest.fixture(scope="module")
def messages(spark):
    from colloq.functions.text import first_number

    df = spark.createDataFrame(MESSAGES, "id bigint, reply string")
    return df.select("id", first_number(F.col("reply")).alias("parent"))


def test_components_are_the_expected_partition(messages):
    got = {}
    for r in graph.conversations(messages, "id", "parent").collect():
        got.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 4, 10], [5], [6], [7, 8], [9]]
    assert all(k == min(v) for k, v in got.items())


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(1, 700).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    star = spark.range(2001, 2500).select(F.col("id").alias("src"), F.lit(2000).cast("bigint").alias("dst"))
    got = graph.connected_components(chain.union(star)).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, 700), (2000, 500)}


def test_components_without_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
    loops = spark.createDataFrame([(3, 3), (None, 1)], "src bigint, dst bigint")
    assert [tuple(r) for r in graph.connected_components(loops).collect()] == [(3, 3)]


def test_chain_roots(messages):
    got = {r.node: (r.root, r.depth, r.cyclic) for r in graph.chain_roots(graph.reply_edges(messages, "id", "parent")).collect()}
    assert got[3] == (1, 2, False) and got[10] == (1, 1, False)
    assert got[7][2] and got[8][2] and got[5][2]
    assert 6 not in got


def test_context_and_replies(spark):
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("CUSTOMER", "a"), ("BRAND", "b"), ("CUSTOMER", "c"), ("CUSTOMER", "d"), ("BRAND", "e")])], "conv_id bigint, turn int, role string, text string")
    rows = cv.customer_corpus(turns).orderBy("turn").select("turn", cv.rendered_context(F.col("context")).alias("c"), "previous_brand", "next_brand", "conv_length").collect()
    assert [tuple(r) for r in rows] == [(0, "", None, "b", 5), (2, "BRAND: b | CUSTOMER: a", "b", "e", 5), (3, "CUSTOMER: c | BRAND: b | CUSTOMER: a", "b", "e", 5)]


def test_message_order_is_by_time_unless_lexical(spark):
    times = ["Wed Nov 22 09:24:30 +0000 2017", "Mon Nov 27 09:24:30 +0000 2017", "Fri Dec 01 09:24:30 +0000 2017"]
    df = spark.createDataFrame([(1, i, t, True, "x", "a") for i, t in enumerate(times)], "conversation_id int, tweet_id int, created_at string, inbound boolean, text string, author_id string")
    order = lambda lexical: [r.message_id for r in cv.from_messages(df, lexical).orderBy("at").collect()]
    assert order(False) == [0, 1, 2] and order(True) == [2, 1, 0]


DOCS = [(1, "where is my order it says delivered", "10", dt.date(2021, 1, 1)), (2, "donde esta mi pedido", "11", dt.date(2021, 2, 1)), (3, "how do I refund my echo dot", "12", dt.date(2022, 1, 1))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string, group string, ts date")


def scores(df):
    return {(r.query_id, r.doc_id): round(r.score, 6) for r in df.collect()}


def test_bm25_values(spark, docs):
    queries = spark.createDataFrame([(1, "where is my order"), (2, "refund echo dot"), (3, "order")], "query_id int, text string")
    got = scores(retrieval.bm25_scores(retrieval.fit(docs, min_df=1), queries))
    assert got == {(1, 1): 3.085763, (1, 3): 0.457883, (2, 3): 2.866607, (3, 1): 0.886920}
    assert scores(retrieval.bm25_scores(retrieval.fit(docs), queries)) == {(1, 1): 0.425003, (1, 3): 0.457883}


def test_tfidf_values(spark, docs):
    queries = spark.createDataFrame([(1, "where is my order"), (2, "refund echo dot")], "query_id int, text string")
    got = scores(retrieval.tfidf_scores(retrieval.fit(docs, tokenizer="tfidf_tokens"), queries))
    assert got == {(1, 1): 0.737538, (1, 3): 0.129458, (2, 3): 0.733341}


def test_zero_scores_stay_eligible_and_masks_apply_after_scoring(spark, docs):
    queries = spark.createDataFrame([(1, "my order", dt.date(2021, 6, 1), None), (2, "order", None, "10")], "query_id int, text string, cutoff date, exclude string")
    index = retrieval.fit(docs, min_df=1)
    every = retrieval.all_pairs(docs, queries, retrieval.bm25_scores(index, queries))
    top = retrieval.top_k(retrieval.masked(every, docs, queries), 3).collect()
    assert [r.doc_id for r in sorted(top, key=lambda r: r.rank) if r.query_id == 1] == [1, 2]
    assert 1 not in [r.doc_id for r in top if r.query_id == 2]


def test_index_round_trip(spark, docs, tmp_path):
    queries = spark.createDataFrame([(1, "where is my order")], "query_id int, text string")
    index = retrieval.fit(docs, min_df=1)
    index.save(str(tmp_path / "i"))
    again = retrieval.LexicalIndex.load(spark, str(tmp_path / "i"))
    assert scores(retrieval.bm25_scores(index, queries)) == scores(retrieval.bm25_scores(again, queries))


def test_hybrid_extremes_rank_as_their_parts(spark):
    dense = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.9, 0.5, 0.1])], "query_id int, doc_id int, score double")
    sparse = spark.createDataFrame([(1, i, s) for i, s in enumerate([3.0, 9.0, 6.0])], "query_id int, doc_id int, score double")
    ranks = lambda a: [r.doc_id for r in sorted(retrieval.top_k(retrieval.hybrid_scores(dense, sparse, [a]), 3).collect(), key=lambda r: r.rank)]
    assert ranks(1.0) == [0, 1, 2] and ranks(0.0) == [1, 2, 0]
    flat = spark.createDataFrame([(1, i, 3.0) for i in range(3)], "query_id int, doc_id int, score double")
    assert {r.score for r in retrieval.hybrid_scores(flat, flat).collect()} == {0.0}


def test_fingerprint(docs):
    assert retrieval.fingerprint(docs).first()[0] == "cases:3:1:3"


def test_recall_and_mrr(spark):
    gold = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 0), ("z", "a", 0)], "query_id string, doc_id string, level int")
    hits = spark.createDataFrame([("q", "x", 1), ("q", "b", 2), ("q", "a", 3)], "query_id string, doc_id string, rank int")
    got = {r.query_id: r for r in metrics.retrieval_per_query(hits, gold, (1, 3)).collect()}
    assert (got["q"].recall_at_1, got["q"].recall_at_3, got["q"].reciprocal_rank) == (0.0, 1.0, 0.5)
    assert (got["z"].recall_at_3, got["z"].reciprocal_rank, got["z"].none_in_5) == (0.0, 0.0, True)
    useful = metrics.retrieval_per_query(hits, gold, (3,), at_least=metrics.USEFUL).where("query_id = 'q'").first()
    assert useful.recall_at_3 == 1.0


def test_classification(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "g string, p string")
    s = metrics.classification_summary(rows, "g", "p").first()
    assert (round(s.macro_f1, 6), round(s.weighted_f1, 6), round(s.accuracy, 6)) == (0.222222, 0.444444, 0.333333)


@pytest.mark.parametrize(("pairs", "expected"), [([(1, 1), (1, 1), (0, 0)], 1.0), ([(1, 1), (1, 0), (0, 1), (0, 0)], 0.0), ([], None), ([(1, 1)], None)])
def test_kappa(spark, pairs, expected):
    rows = spark.createDataFrame([(bool(a), bool(b)) for a, b in pairs], "a boolean, b boolean")
    assert metrics.kappa(rows, F.col("a"), F.col("b")).first()["kappa"] == expected


def test_ece(spark):
    rows = spark.createDataFrame(list(zip([0.1, 0.3, 0.3, 0.9, 1.0], [0, 1, 0, 1, 1])), "c double, y int")
    assert round(metrics.expected_calibration_error(rows, F.col("c"), F.col("y")).first()["ece"], 6) == 0.12


def test_order_statistics(spark):
    rows = spark.range(1, 31).select(F.col("id").cast("double").alias("v"))
    got = metrics.order_statistics(rows, "v", 0.95).first()
    assert got.floor_index == 28 and round(got.interpolated, 2) == 28.55


@pytest.mark.parametrize(
    ("intent", "p", "sims", "comb_low", "action", "confidence", "reason"),
    [
        ("delivery_delay", 0.20, [0.4], 0.45, "escalate", 0.28, "comb_low"),
        ("none", 0.90, [0.4], 0.45, "escalate", 0.70, "no actionable"),
        ("delivery_delay", 0.30, [0.4], 0.70, "escalate", 0.34, "comb_low"),
        ("refund_request", 0.95, [], 0.45, "escalate", 0.57, "high-risk"),
        ("delivery_delay", 0.85, [0.45, 0.40, 0.39], 0.45, "auto_handle", 0.675333, "confident"),
        ("charge_issue", 0.99, [0.6, 0.55, 0.5], 0.45, "escalate", 0.814, "high-risk"),
    ],
)
def test_decide(spark, intent, p, sims, comb_low, action, confidence, reason):
    row = spark.createDataFrame([(intent, p, [(s, "reply") for s in sims])], "intent string, p double, hits array<struct<score:double,brand_response:string>>")
    d = row.select(policy.decide(F.col("intent"), F.col("p"), F.col("hits"), policy.Thresholds(comb_low=comb_low)).alias("d")).first()["d"]
    assert d.action == action and round(d.confidence, 6) == confidence and reason in d.reason


def test_thresholds_load(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"thresholds": {"comb_low": 0.8}, "sim_floor": 0.1}))
    th = policy.Thresholds.load(str(path))
    assert (th.comb_low, th.sim_floor, th.p_intent_low) == (0.8, 0.1, 0.30)
    assert policy.Thresholds.load(str(tmp_path / "none.json")) == policy.Thresholds()


def test_drafts(spark):
    df = spark.createDataFrame([("We are sorry, a new one is on its way.",), (None,)], "r string")
    a, b = [r[0] for r in df.select(policy.draft_auto(F.col("r"))).collect()]
    assert a.startswith(policy.OPENERS["sorry"]) and "on its way" in a and a.endswith(policy.NEXT_STEP)
    assert b == f"{policy.opener('default', '')} {policy.NEXT_STEP}"


def test_splits_are_disjoint_and_whole(spark):
    rows = spark.range(0, 400).select((F.col("id") % 100).alias("g"), "id")
    parts = sampling.split_groups(rows, "g", {"train": 0.7, "val": 0.15, "test": 0.15}, sampling.portable_hash(F.col("g")))
    assert parts.count() == 400
    per = {r.split: r.n for r in parts.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()}
    assert per == {"train": 70, "val": 15, "test": 15}
    sampling.assert_disjoint({s: parts.where(F.col("split") == s) for s in per}, "g")


def test_guards(spark):
    a, b = spark.range(3), spark.range(2, 5)
    with pytest.raises(sampling.OverlapError):
        sampling.assert_disjoint({"a": a, "b": b}, "id")
    with pytest.raises(sampling.OverlapError):
        sampling.assert_subset(a, b, "id")
    sampling.assert_subset(spark.range(1), a, "id")


@pytest.mark.parametrize(
    ("sizes", "want", "expected"),
    [
        ({"a": 50, "b": 30, "c": 2}, 10, {"a": 5, "b": 4, "c": 1}),
        ({"a": 3, "b": 3}, 4, {"a": 2, "b": 2}),
        ({"a": 5, "b": 4, "c": 3, "d": 2, None: 1}, 2, {"a": 1, "b": 1, "c": 0, "d": 0, None: 0}),
        ({"a": 1, "b": 2}, 99, {"a": 1, "b": 2}),
        ({}, 5, {}),
    ],
)
def test_quotas_add_up(spark, sizes, want, expected):
    rows = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "s string, i int")
    assert {r.s: r.quota for r in sampling.quotas(rows, "s", want).collect()} == expected
    assert sampling.quota_pick(rows, "s", want, [F.col("i")]).count() == min(want, sum(sizes.values()))


def test_ranked_rows_and_overlaps(spark):
    rows = spark.range(500).select(((F.col("id") * 7919) % 500).alias("v"))
    assert all(r.v + 1 == r.place for r in sampling.ranked_rows(rows, [F.col("v")], "place").collect())
    found = sampling.pairwise_overlaps({"a": spark.range(3), "b": spark.range(2, 5), "c": spark.range(9, 10)}, "id")
    assert sorted(map(tuple, found.collect())) == [("a", "b", 1), ("a", "c", 0), ("b", "c", 0)]


def test_rare_words_count_for_tfidf_and_zeros_fill_up(spark):
    docs = spark.createDataFrame([(1, "zebra crossing"), (2, "a crossing"), (3, "")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "zebra"), (2, "nothing")], "query_id int, text string")
    found = retrieval.tfidf_scores(retrieval.fit(docs, tokenizer="tfidf_tokens"), queries)
    top = retrieval.top_k_with_zeros(docs, queries, found, 3).collect()
    assert sorted((r.query_id, r.rank, r.doc_id) for r in top) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3)]
    assert [r.score > 0 for r in sorted(top, key=lambda r: (r.query_id, r.rank))] == [True] + [False] * 5


def test_index_build_is_reused_only_for_its_corpus(spark, docs, tmp_path):
    path, queries = str(tmp_path / "i"), spark.createDataFrame([(1, "my order")], "query_id int, text string")
    first = retrieval.build_index(docs, path, min_df=1)
    assert retrieval.build_index(docs, path, min_df=1).meta["build_seconds"] == first.meta["build_seconds"] and first.meta["version"] == "cases:3:1:3"
    less = retrieval.build_index(docs.where("doc_id > 1"), path, min_df=1)
    assert less.meta["version"] == "cases:2:2:3" and less.totals[0] == 2
    assert scores(retrieval.bm25_scores(less, queries)) == scores(retrieval.bm25_scores(retrieval.fit(docs.where("doc_id > 1"), min_df=1), queries))
    capped = retrieval.fit(docs, min_df=1, max_terms=2)
    assert capped.terms.count() == 2 and retrieval.bm25_scores(capped, queries).count() > 0


def test_all_indexes_are_built_once(spark, docs, tmp_path):
    variants = {"msg": docs, "ctx": docs.withColumn("text", F.concat("text", F.lit(" context")))}
    first = retrieval.build_all(variants, str(tmp_path / "all")).collect()
    assert {(r.model, r.variant) for r in first} == {(m, v) for m in ("bm25", "tfidf") for v in variants}
    assert sorted(first) == sorted(retrieval.build_all(variants, str(tmp_path / "all")).collect())


def test_classifier_round_trip_and_idf(spark, tmp_path):
    rows = [(i, t, label) for i, (t, label) in enumerate([("refund my money", "refund"), ("money back refund", "refund"), ("late parcel", "late"), ("parcel is late again", "late")])]
    df = ml.with_ngrams(spark.createDataFrame(rows, "id int, text string, label string"))
    model = ml.text_classifier(df, min_df=1)
    import math

    weights = {r.term: r.idf for r in model.features.terms.collect()}
    assert abs(weights["refund"] - (math.log(5 / 3) + 1)) < 1e-9
    ml.save(model, str(tmp_path / "m"))
    again = ml.predict(ml.load(str(tmp_path / "m")), df)
    assert [r.predicted for r in again.orderBy("id").collect()] == ["refund", "refund", "late", "late"]


def test_agent_answers_from_all_parts(spark):
    queries = spark.createDataFrame([("q", "my parcel is late"), ("z", "hm")], "query_id string, text string")
    intents = spark.createDataFrame([("q", "delivery_delay", 0.9)], "query_id string, intent string, p double")
    hits = spark.createDataFrame([("q", "c2", 0.5, 2), ("q", "c1", 0.9, 1), ("q", "gone", 0.4, 3)], "query_id string, doc_id string, score double, rank int")
    cases = spark.createDataFrame([("c1", "We are sorry, it is on its way.", "en"), ("c2", None, "en")], "doc_id string, brand_response string, language string")
    got = {r.example_id: r for r in policy.answer(queries, intents, hits, cases).collect()}
    assert (got["q"].action, got["q"].n_evidence, got["q"].n_usable, got["q"].sim_mean) == ("auto_handle", 2, 1, 0.7) and "on its way" in got["q"].draft
    assert (got["z"].action, got["z"].n_evidence) == ("escalate", 0)


def test_job_manifest(spark, tmp_path):
    from colloq.providers import router

    requests, responses = spark.range(5), spark.createDataFrame([("0", "ok"), ("1", "ok"), ("2", "error")], "id string, status string")
    job = router.job_of("labels", requests, responses, 3)
    job.save(str(tmp_path / "job.json"))
    assert router.Job.load(str(tmp_path / "job.json")) == job == router.Job("labels", 3, 5, 2, 1, 2) and not job.complete


def test_replies_of_a_long_conversation(spark):
    """Each row enters its window frame once, whichever way it looks."""
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 9_999 == 0, "BRAND").otherwise("CUSTOMER").alias("role"), F.col("id").cast("string").alias("text"))
    got = cv.with_replies(turns, "conv_id", ["turn"], F.col("role") == "BRAND", F.col("text")).where("turn in (5, 9999, 19999)").orderBy("turn").collect()
    assert [(r.previous_brand, r.next_brand) for r in got] == [("0", "9999"), ("0", "19998"), ("19998", None)]


def test_templates_and_empty_tables(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,)], "template_key string")
    got = sorted((r.template_key or "", r.template_count, r.is_canned_template) for r in cv.with_template_counts(df, canned_at=2).collect())
    assert got == [("", 0, False), ("x", 2, True), ("x", 2, True)]
    assert stats.null_rates(spark.createDataFrame([], "a int"), ["a"]).first()["null_rate"] is None


def test_top_two(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5],), ([1.0],)], "p array<double>")
    got = [tuple(r[0]) for r in df.select(ml.top_two(F.col("p"))).collect()]
    assert got == [(1, 0.5, 0.0), (0, 1.0, 1.0)]


def test_calibration_hits_the_target_rate(spark):
    rows = spark.createDataFrame([("delivery_delay", i / 10, [(0.5, "r")]) for i in range(1, 10)], "intent string, p double, hits array<struct<score:double,brand_response:string>>")
    floor = policy.calibrate(rows, 0.25)
    assert round(floor, 6) == round(0.6 * 0.3 + 0.4 * 0.5, 6)
    swept = {r.floor: r.n_escalated for r in policy.sweep(rows, [0.0, floor, 1.1]).collect()}
    assert swept == {0.0: 0, floor: 2, 1.1: 9}


def test_results_do_not_depend_on_the_partitions(spark):
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 200)], "src bigint, dst bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, graph.connected_components(edges.repartition(int(n))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_dense_search_with_many_batches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BATCH", 2)
    monkeypatch.setattr(retrieval, "BROADCAST_BATCHES", 1)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "doc_id bigint, embedding array<float>")
    queries = vectors.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    got = scores(retrieval.dense_scores(vectors, queries))
    assert got == {(q, d): float(q * d + 1) for q in range(5) for d in range(6)}
    assert retrieval.dense_scores(vectors, queries.limit(0)).count() == 0
