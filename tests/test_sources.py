"""Readers, sinks, providers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from colloq.operators import conversations as cv
from colloq.providers import router as pr
from colloq.sources import readers, sinks
from colloq.streaming import events as ev

SCHEMA = {"required": ["label"], "properties": {"label": {"enum": ["a", "b"]}}}


def test_messages_and_cache(spark, tmp_path):
    source = tmp_path / "m.csv"
    source.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,a,True,x,"two\nlines, ""quoted""",2,\n2,B,False,y,ok,,1\n')
    df = readers.messages(spark, str(source))
    assert df.where("tweet_id = 1").first()["text"] == 'two\nlines, "quoted"'
    cached = readers.build_cache(spark, str(source), str(tmp_path / "c"))
    assert cached.columns == df.columns and cached.count() == 2
    with pytest.raises(readers.MissingSourceError):
        readers.parquet(spark, str(tmp_path / "none"))


def test_tsv_labels(spark, tmp_path):
    p = tmp_path / "l.tsv"
    p.write_text("x1\tescalate\tmoney\tand more\nx2\tauto_handle\t\n")
    rows = readers.tsv_labels(spark, str(p), ["escalate", "auto_handle"]).orderBy("example_id").collect()
    assert [tuple(r) for r in rows] == [("x1", "escalate", "money\tand more"), ("x2", "auto_handle", "")]
    p.write_text("x1\tmaybe\t\n")
    with pytest.raises(Exception, match="outside the domain"):
        readers.tsv_labels(spark, str(p), ["escalate"]).collect()


def test_small_documents(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps({"seed": 1, "conversation_ids": [3, 4]}))
    assert readers.id_document(str(tmp_path / "ids.json")) == [3, 4]
    (tmp_path / "t.yaml").write_text("intents:\n  - id: one\n    name: x\n  - id: 'two'\n")
    names = readers.taxonomy(str(tmp_path / "t.yaml"))
    assert [r.label for r in readers.label_table(spark, names).orderBy("ord").collect()] == ["one", "two", "none", "other_unclear"]
    (tmp_path / "e").write_text("# c\nCOLLOQ_TEST_KEY='v'\n\n")
    assert readers.load_env(str(tmp_path / "e")) == {"COLLOQ_TEST_KEY": "v"}
    assert readers.dict_rows(spark, {1: ("a", 2)}, ["k", "x", "y"]).count() == 1


def test_latest_timestamp_ignores_malformed_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"created_at": "Wed Nov 22 09:24:30 +0000 2017"}\nnot json\n{"created_at": "zzz"}\n')
    assert readers.latest_timestamp(spark, str(p)) == "Wed Nov 22 09:24:30 +0000 2017"


def test_cases_prefer_slim(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "CUSTOMER", "where is it"), (1, 1, "BRAND", "Sorry, on its way")], "conv_id bigint, turn int, role string, text string")
    made = cv.cases(cv.customer_corpus(turns))
    sinks.slim_corpus(made, str(tmp_path / "slim.parquet"))
    row = readers.cases(spark, str(tmp_path)).first()
    assert row.metadata["contains_apology"] and row.conversation_context == [] and row.doc_msg == "where is it"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("10", ["a", "b"]), ("9", [])], "id string, codes array<string>")
    sinks.csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("id = '10'").first()["codes"] == "a;b"
    sinks.jsonl(df.coalesce(1), str(tmp_path / "j"), "id")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.json_report({"t": df}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["t"][0]["id"] == "10"
    assert sinks.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y int")) == "| x | y |\n|---|---|\n| a\\|b |  |"


def provider(name, answers):
    it = iter(answers)

    def call(system, user):
        found = next(it)
        if isinstance(found, Exception):
            raise found
        return found

    return pr.TextProvider(name, call, attempts=1, sleep=lambda s: None)


def test_router_falls_back_and_stops_on_permanent_errors():
    ok = '```json\n{"label": "a"}\n```'
    r = pr.Router(provider("p", [pr.ProviderError("x"), ok]), None, attempts=2, sleep=lambda s: None)
    assert r.complete("s", "u", SCHEMA) == ("p", {"label": "a"}) and r.attempted == ["p", "p"]
    r = pr.Router(provider("p", [pr.PermanentError("x"), ok]), provider("f", [ok]), attempts=3, sleep=lambda s: None)
    assert r.complete("s", "u", SCHEMA)[0] == "f" and r.attempted == ["p", "f"]
    with pytest.raises(pr.ProviderError, match="missing keys"):
        pr.Router(provider("p", ["{}"]), None).complete("s", "u", SCHEMA)
    with pytest.raises(pr.ProviderError, match="no provider"):
        pr.Router(None).complete("s", "u", SCHEMA)
    assert pr.Router(provider("p", []), None).available() == ["p"]


def test_text_provider_retries():
    waits = []
    answers = iter(["nope", '{"label": "z"}', '{"label": "b"}'])
    p = pr.TextProvider("p", lambda s, u: next(answers), attempts=3, sleep=waits.append)
    assert p.complete("s", "u", SCHEMA) == {"label": "b"} and len(waits) == 2 and waits[1] > waits[0]


def test_classify_keeps_errors_as_rows(spark):
    def make():
        from colloq.providers import router

        def call(system, user):
            if user == "bad":
                raise router.ProviderError("refused")
            return '{"label": "a"}'

        return router.Router(router.TextProvider("fake", call, attempts=1))

    rows = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "id int, text string")
    got = pr.classify(rows, make, "s", SCHEMA, max_calls=2).orderBy("id").collect()
    assert [(r.id, r.status, r.provider) for r in got] == [("1", "ok", "fake"), ("2", "error", None)]


def test_judged(spark):
    df = spark.createDataFrame([("1", "ok", '{"x": true}'), ("2", "ok", '{"x": {"score": 70}}'), ("3", "ok", "{}")], "id string, status string, response string")
    assert [r.x for r in pr.judged(df, ["x"]).orderBy("id").collect()] == [True, True, None]


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    schema = ", ".join(f"{c} {t}" for c, t in events.dtypes)
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    live = lambda: ev.source(spark, str(tmp_path / "in"), schema)
    a = run(ev.tumbling(live()), "tumbling", "complete").select("window_start", "event_type", "n")
    assert a.exceptAll(ev.tumbling(events).select("window_start", "event_type", "n")).isEmpty()
    assert run(ev.deduplicated(live()), "dedup", "append").count() == events.select("event_id").distinct().count()
    totals = run(ev.running_totals(live()), "totals", "update").groupBy("user_id").agg(F.max("n").alias("n"))
    assert totals.exceptAll(events.groupBy("user_id").agg(F.count("*").alias("n"))).isEmpty()
