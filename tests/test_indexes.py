"""Indexes with bounds against plain search, stored embeddings, the agent under time, chains of any depth, fitted models, chat sessions."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloq.operators import agent, block_index, dense_index, embeddings, graph, ml, retrieval
from colloq.streaming import chat

# --- dense


def dense_rows(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in df.collect())


def plain_top(vectors, queries, k, digits=6, allowed=lambda q, d: True):
    out = []
    for q, x in queries.items():
        best = sorted((-round(float(np.dot(x, y)), digits), d) for d, y in vectors.items() if allowed(q, d))[:k]
        out += [(q, i + 1, d, round(-s, 6) + 0.0) for i, (s, d) in enumerate(best)]
    return sorted(out)


def clustered(seed, n, dim=8, families=12, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(families, dim))
    return {i: (centres[i % families] * rng.uniform(0.5, 2) + rng.normal(size=dim) * spread).astype(np.float32).astype(float) for i in range(n)}


def frame(spark, vectors, name="doc_id", **more):
    extra = list(more)
    rows = [(i, v.tolist() if v is not None else None, *[more[c].get(i) for c in extra]) for i, v in vectors.items()]
    kinds = {"ts": "bigint", "cutoff": "bigint", "group": "string", "exclude": "string"}
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>" + "".join(f", {c} {kinds[c]}" for c in extra))


def test_dense_index_skips_and_is_exact(spark, tmp_path):
    vectors = clustered(1, 600)
    queries = {q: vectors[q] for q in range(0, 600, 40)}
    index = dense_index.fit(frame(spark, vectors), cells=24, rings=16)
    hits, report = dense_index.search(index, frame(spark, queries, "query_id"), 5, digits=6)
    assert dense_rows(hits) == plain_top(vectors, queries, 5)
    looked = report.agg(F.sum("compared").alias("c"), F.sum("rows").alias("r"), F.sum("skipped").alias("s"), F.sum("blocks").alias("b")).first()
    assert looked.c < looked.r / 2 and looked.s > looked.b / 2
    index.save(str(tmp_path / "i"))
    again, _ = dense_index.search(dense_index.DenseIndex.load(spark, str(tmp_path / "i")), frame(spark, queries, "query_id"), 5, digits=6)
    assert dense_rows(again) == plain_top(vectors, queries, 5)


def test_dense_index_of_noise_zeros_and_ties(spark, monkeypatch):
    monkeypatch.setattr(dense_index, "BATCH", 4)
    monkeypatch.setattr(dense_index, "BUFFER", 16)
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=5).astype(np.float32).astype(float) for i in range(120)}
    vectors |= {200 + i: vectors[3] for i in range(30)} | {300: np.zeros(5), 301: np.zeros(5)}
    queries = {q: vectors[q] for q in (0, 3, 7, 205, 300, 11, 13, 17, 19)} | {900: -vectors[3]}
    hits, _ = dense_index.search(dense_index.fit(frame(spark, vectors), cells=7, rings=4), frame(spark, queries, "query_id"), 12, digits=6)
    assert dense_rows(hits) == plain_top(vectors, queries, 12)


def test_dense_index_under_masks(spark):
    vectors = clustered(3, 200)
    ts, group = {i: i * 10 for i in vectors}, {i: f"g{i % 4}" for i in vectors}
    ts[7] = None
    queries = {q: vectors[q] for q in (0, 5, 60, 150, 199)}
    cutoff, exclude = {0: 0, 5: 300, 60: None, 150: 1500, 199: -1}, {0: None, 5: "g1", 60: "g0", 150: "g2", 199: "g1"}
    index = dense_index.fit(frame(spark, vectors, ts=ts, group=group), cells=10, rings=8)
    hits, report = dense_index.search(index, frame(spark, queries, "query_id", cutoff=cutoff, exclude=exclude), 6, digits=6)

    def allowed(q, d):
        return (cutoff[q] is None or ts[d] is None or ts[d] <= cutoff[q]) and (exclude[q] is None or group[d] != exclude[q])

    assert dense_rows(hits) == plain_top(vectors, queries, 6, allowed=allowed)
    assert report.count() == 5


def test_dense_index_of_nothing(spark):
    empty = frame(spark, {1: None})
    index = dense_index.fit(empty)
    assert dense_index.search(index, frame(spark, {1: np.ones(3)}, "query_id"), 3)[0].count() == 0
    full = dense_index.fit(frame(spark, {1: np.ones(3)}))
    assert dense_index.search(full, frame(spark, {1: None}, "query_id"), 3)[0].count() == 0


# --- lexical


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(4000)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize(("model", "tokenizer"), [("bm25", "tokens"), ("tfidf", "tfidf_tokens")])
def test_block_index_equals_scoring_all(spark, tmp_path, model, tokenizer):
    rows = texts(5, 300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(20)] + [(90, ""), (91, None), (92, "unknown words"), (93, "w399 w398 w1 w1")], "query_id int, text string")
    flat = retrieval.fit(docs, tokenizer=tokenizer)
    scores = retrieval.bm25_scores(flat, queries) if model == "bm25" else retrieval.tfidf_scores(flat, queries)
    expected = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in retrieval.top_k(scores, 5, digits=6).where("score > 0").collect())
    index = block_index.fit(docs, model, block_docs=8)
    hits, report = block_index.search(index, queries, 5, digits=6)
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in hits.collect()) == expected
    looked = report.agg(F.sum("skipped").alias("s"), F.sum("blocks").alias("b"), F.count("*").alias("n")).first()
    assert looked.n == 24 and looked.s > looked.b / 4
    index.save(str(tmp_path / "i"))
    again, _ = block_index.search(block_index.BlockIndex.load(spark, str(tmp_path / "i")), queries, 5, digits=6)
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in again.collect()) == expected


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (None,), (["x"],)], "t array<string>")
    got = [r[0] and sorted(map(tuple, r[0])) for r in df.select(retrieval.term_counts(F.col("t"))).collect()]
    assert got == [[("a", 1), ("b", 3)], [], [], [("x", 1)]]


# --- stored embeddings


def stored(store):
    return {r.doc_id: tuple(round(x, 5) for x in r.embedding) for r in store.vectors().collect()}


def encoded(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: tuple(round(x, 5) for x in r.e) for r in df.select("doc_id", embeddings.unit(embeddings.hashed_encoder(8)(F.col("text"))).alias("e")).collect()}


def test_embeddings_follow_edits_removals_and_a_killed_run(spark, tmp_path, monkeypatch):
    store, encode = embeddings.EmbeddingStore(spark, str(tmp_path / "e")), embeddings.hashed_encoder(8)
    rows = [(i, f"some words {i} here") for i in range(6)]
    docs = lambda r: spark.createDataFrame(r, "doc_id bigint, text string")
    put = embeddings.EmbeddingStore._put

    def killed(self, path, value):
        if path.startswith("log/"):
            raise RuntimeError("killed between the rows and their commit")
        put(self, path, value)

    monkeypatch.setattr(embeddings.EmbeddingStore, "_put", killed)
    with pytest.raises(RuntimeError):
        store.build(docs(rows), "hashed", 8, encode)
    monkeypatch.setattr(embeddings.EmbeddingStore, "_put", put)
    assert stored(store) == {} and not store.valid(docs(rows), "hashed", 8)
    store.build(docs(rows + rows), "hashed", 8, encode, parts=3)
    assert stored(store) == encoded(spark, rows) and store.valid(docs(rows), "hashed", 8)
    edited = [(0, "quite another text"), *rows[2:], (9, None), (None, "no id")]
    assert not store.valid(docs(edited), "hashed", 8)
    store.build(docs(edited), "hashed", 8, encode)
    assert stored(store) == encoded(spark, edited[:-1])
    n = len(store.commits())
    store.build(docs(edited), "hashed", 8, encode)
    assert len(store.commits()) == n
    store.compact()
    assert stored(store) == encoded(spark, edited[:-1]) and len(store.commits()) == 1
    store.build(docs(rows), "hashed", 8, encode)
    assert stored(store) == encoded(spark, rows)
    with pytest.raises(embeddings.StaleEmbeddings):
        store.build(docs(rows), "other", 8, encode)


def test_embeddings_of_a_stream_that_dies(spark, tmp_path):
    store, encode = embeddings.EmbeddingStore(spark, str(tmp_path / "e")), embeddings.hashed_encoder(8)
    schema = "doc_id bigint, text string, deleted boolean"
    batches = [[(1, "one two three", False), (2, "four five", False)], [(2, "four six", False), (1, None, True), (3, "seven eight", None)]]
    failing = {"left": 1}

    def commit(self, key, changes, enc, plain=embeddings.EmbeddingStore.commit):
        if failing["left"] and key.endswith("1"):
            failing["left"] -= 1
            changes.select("doc_id").write.mode("overwrite").parquet(f"{self.path}/batches/{key}")  # rows of a run that dies before its commit
            raise RuntimeError("killed")
        return plain(self, key, changes, enc)

    class Dying(embeddings.EmbeddingStore):
        pass

    Dying.commit = commit
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = embeddings.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), Dying(spark, store.path), "hashed", 8, encode, str(tmp_path / "state"))
        if k:
            with pytest.raises(Exception, match="killed"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    assert stored(store) == encoded(spark, [(1, "one two three"), (2, "four five")])
    embeddings.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, "hashed", 8, encode, str(tmp_path / "state")).awaitTermination()
    assert stored(store) == encoded(spark, [(2, "four six"), (3, "seven eight")])
    assert [c["key"] for c in store.commits()] == ["stream-000000000", "stream-000000001"]


# --- chains


@pytest.mark.parametrize("n", [1, 2, 257, 1390, 10_000])
def test_chains_of_any_depth(spark, n):
    edges = spark.range(1, n + 1).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    found = graph.chain_roots(edges)
    assert found.where("root <> 0 or depth <> node or cyclic or root is null or depth is null").count() == 0 and found.count() == n


def test_cycles_with_tails_beside_long_chains(spark):
    chain = [(i, i - 1) for i in range(1, 301)]
    ring = [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)]
    tail = [(2000 + i, 2000 + i + 1 if i < 39 else 1003) for i in range(40)]
    rows = chain + ring + tail + [(5000, 5000), (6000, 5000), (7000, None)]
    found = {r.node: (r.root, r.depth, r.cyclic) for r in graph.chain_roots(spark.createDataFrame(rows, "src bigint, dst bigint")).collect()}
    assert found == {i: (0, i, False) for i in range(1, 301)} | {a: (None, None, True) for a, _ in [*ring, *tail, (5000, 0), (6000, 0)]}
    clipped = graph.chain_roots(spark.createDataFrame(chain, "src bigint, dst bigint"), max_depth=200).agg(F.max("depth").alias("d"), F.bool_or("cyclic").alias("c"), F.max("root").alias("r")).first()
    assert (clipped.d, clipped.c, clipped.r) == (200, False, 0)


# --- the agent


def test_agent_sees_nothing_later_than_its_query(spark, tmp_path):
    rng = random.Random(6)
    words = ["parcel", "refund", "late", "broken", "account", "order", "charge", "locked", "again", "please"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(6)), i // 3, f"c{i // 5}", None if i % 4 == 0 else f"We are sorry about number {i}.", "en") for i in range(80)]
    cases = spark.createDataFrame(rows, "doc_id bigint, message string, ts bigint, group string, brand_response string, language string")
    made = agent.Agent.of(cases)
    asked = cases.select(F.col("doc_id").alias("query_id"), F.col("message").alias("text"), F.col("ts").alias("cutoff"), F.col("group").alias("exclude"))
    hits = made.evidence(asked).join(cases.select("doc_id", "ts", "group"), "doc_id").join(asked.select("query_id", "cutoff", "exclude"), "query_id")
    assert hits.where("ts > cutoff or group = exclude").count() == 0 and hits.count() > 300
    plain = {r.example_id: r.asDict() for r in made.respond(asked).collect()}
    assert len(plain) == 80 and plain[0]["n_evidence"] == 0 and plain[0]["action"] == "escalate"
    made.save(str(tmp_path / "a"))
    loaded = agent.Agent.load(spark, str(tmp_path / "a"))
    assert {r.example_id: r.asDict() for r in loaded.respond(asked).collect()} == plain


# --- models


def test_squared_hinge_is_the_minimum(spark):
    """Against gradient descent on the whole objective in numpy: same weights, and the published weighing of the classes."""
    rows = [(i, t, y) for i, (t, y) in enumerate([("red apple pie", "a"), ("red apple", "a"), ("green pear", "b"), ("pear tart green", "b"), ("blue plum", "c"), ("plum red", "c"), ("apple plum", "a"), ("pear blue", "b")])]
    df = ml.with_ngrams(spark.createDataFrame(rows, "id int, text string, label string"))
    model = ml.text_classifier(df, min_df=1, c=1.0, kind="svc", balanced=True, iterations=500)
    table = model.features.table(df.select("id", "label", "terms"))
    x = np.zeros((len(rows), model.features.size + 1))
    x[:, -1] = 1
    for r in table.plain.collect():
        x[r.id, list(r.features.indices)] = r.features["values"]
    labels = np.array([y for *_, y in rows])
    assert np.allclose((x[:, :-1] ** 2).sum(1), 1)
    for k, name in enumerate(model.labels):
        side = np.where(labels == name, 1.0, -1.0)
        cost = np.where(side > 0, len(rows) / (3 * (labels == name).sum()), 1.0)
        w = np.zeros(x.shape[1])
        for _ in range(20_000):
            slack = np.maximum(0, 1 - side * (x @ w))
            w -= 0.02 * (w - 2 * x.T @ (cost * side * slack))
        assert np.allclose(model.weights[:, k], w, atol=2e-3)
    got = {r.id: r.predicted for r in ml.predict(model, df).collect()}
    assert [got[i] for i, *_ in rows] == labels.tolist()
    placed = model.features.table(df.withColumn("label_index", (F.ascii("label") - 97).cast("double")).select("label_index", "terms")).plain
    weight = [len(rows) / (3 * (labels == name).sum()) for name in model.labels]
    spread = ml.squared_hinge(placed.repartition(3), model.features.size, 3, weight, 1.0, one_task=2)  # a job for each gradient
    assert np.allclose(spread, model.weights, atol=1e-3)


def test_saved_svc_and_a_text_without_known_words(spark, tmp_path):
    df = ml.with_ngrams(spark.createDataFrame([(0, "refund money", "x"), (1, "late parcel", "y"), (2, "refund", "x"), (3, "parcel", "y")], "id int, text string, label string"))
    model = ml.text_classifier(df, min_df=1, kind="svc")
    ml.save(model, str(tmp_path / "m"))
    new = ml.with_ngrams(spark.createDataFrame([(7, "my refund"), (8, None), (9, "nothing known")], "id int, text string"))
    first, again = ([(r.id, r.predicted, round(r.margin, 9)) for r in ml.predict(m, new).orderBy("id").collect()] for m in (model, ml.load(str(tmp_path / "m"))))
    assert first == again and first[0][1] == "x" and len(first) == 3


def test_grid_covers_both_inputs(spark):
    rows = spark.createDataFrame([(i, "rare words here" if i % 6 == 0 else "many common words", "many" if i % 2 else "few", "b" if i % 6 == 0 else "a") for i in range(24)], "id int, message string, more string, label string")
    got = ml.baseline_grid(rows, rows, ["message", "more"])
    assert got.count() == 2 * 3 * 24
    right = {(r.input, r.model): r.n for r in got.where("gold = predicted").groupBy("input", "model").agg(F.count("*").alias("n")).collect()}
    assert right["message", "svc"] == right["message", "logistic"] == 24 and right["message", "majority"] == right["more", "majority"] == 20


def test_cheapest_clusters_and_their_terms(spark):
    rng = np.random.default_rng(8)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    rows = [(i, (centres[i % 4] + rng.normal(size=2) * 0.1).tolist()) for i in range(80)]
    vectors = spark.createDataFrame(rows, "id int, embedding array<double>")
    found, members = ml.clusters(vectors, k=4, starts=4, with_members=True)
    assert {r.size for r in found.collect()} == {20}
    groups = {r.id: r.cluster for r in members.collect()}
    assert all(groups[i] == groups[i % 4] for i in range(80)) and len(set(groups.values())) == 4
    said = spark.createDataFrame([(i, f"family{'abcd'[i % 4]} word") for i in range(80)], "id int, text string").withColumn("text", F.regexp_replace("text", "family", "kin"))
    first = {r.cluster: r.term for r in ml.cluster_terms(members, said, k=1).collect()}
    assert first == {groups[i]: f"kin{'abcd'[i]}" for i in range(4)}


# --- chat


def test_chat_stream_goes_on_after_a_restart(spark, tmp_path):
    start, begun = datetime(2020, 2, 28, 23, 58), datetime(2021, 5, 1, 12)
    rng, rows = random.Random(9), []
    for s in range(5):
        at = begun
        for n in range(40):
            at += timedelta(minutes=rng.choice([1, 3, 29, 31, 200]))
            rows.append((s, n, at, chat.RESET if rng.random() < 0.1 else f"m{n}"))
    schema = "session bigint, number bigint, at timestamp, text string"
    limits = sorted(r[2] for r in rows)
    for low, high in [(limits[0], limits[60]), (limits[60], limits[140]), (limits[140], datetime(2100, 1, 1))]:
        spark.createDataFrame([r for r in rows if low <= r[2] < high], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        chat.run(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out"), start)
    got = sorted(map(tuple, spark.read.schema(chat.TURN).parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, chat.turns(spark.createDataFrame(rows, schema), start).collect()))
    plain, open_ = [], {}
    for s, n, at, text in sorted(rows):
        history, seen = open_.get(s, ([], None))
        if text == chat.RESET or (seen is not None and at - seen > timedelta(minutes=30)):
            history = []
        if text != chat.RESET:
            plain.append((s, n, len(history) + 1, start + timedelta(minutes=len(history) + 1), "\n".join(history), text))
            history = [*history, text]
        open_[s] = (history, at)
    assert got == sorted(plain)
    assert any(r[3].date() == datetime(2020, 2, 29).date() for r in got) and math.isclose(len(got), len(plain))


def test_variants_are_built_measured_and_searched(spark, tmp_path):
    from colloq.operators import variants
    from colloq.operators.sampling import portable_hash

    rows = [(i, t, f"before {i % 3} {t}") for i, t in texts(11, 60) if t]
    docs = spark.createDataFrame(rows, "doc_id bigint, msg string, ctx string")
    retrievers = variants.Retrievers(docs, str(tmp_path / "v"), ("msg", "ctx"))
    made = retrievers.build().collect()
    assert {(r.model, r.variant) for r in made} == {(m, v) for m in ("bm25", "tfidf", "dense") for v in ("msg", "ctx")}
    assert all(r.n_docs == len(rows) and r.bytes > 0 and r.build_seconds > 0 for r in made)
    asked = docs.where("doc_id < 4").withColumnRenamed("doc_id", "query_id")
    hits = retrievers.hits(asked, 3)
    assert {r.model for r in hits.collect()} == {f"{m}/{v}" for m in variants.MODELS for v in ("msg", "ctx")}
    assert hits.where("rank = 1 and model like 'dense%' and score < 0.99").count() == 0
    curve = variants.scaling(docs.select("doc_id", F.col("msg").alias("text")), asked.select("query_id", F.col("msg").alias("text")), str(tmp_path / "s"), (10, 40), portable_hash(F.col("doc_id")))
    assert sorted((r.model, r["size"]) for r in curve.collect()) == [("bm25", 10), ("bm25", 40), ("dense", 10), ("dense", 40)]
