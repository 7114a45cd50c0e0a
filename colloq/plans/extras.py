"""Further queries: message shapes, pools, zero rows, learning curves, agreement, payloads and the whole hand-off chain."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions import text as tx
from colloq.operators import agent, ml, policy, sampling, stats, variants
from colloq.operators import conversations as cv
from colloq.operators import metrics as me
from colloq.plans.conversations import TURNS_SQL, WINDOWED_SQL, corpus, turns
from colloq.plans.registry import query
from colloq.plans.retrieval import BM25_SQL, TFIDF_SQL, TOKENS
from colloq.plans.texts import draft_parts
from colloq.session import checkpoint_dir, read, write_table
from colloq.streaming import chat


def _rules_sql(text: str) -> str:
    """Whether no keyword rule fits, in SQL."""
    return " AND ".join(f"NOT regexp_matches({text}, '{p}')" for p in tx.RUBRIC.values())


@query(f"""WITH {TURNS_SQL}, t AS (SELECT conv_id, turn, text_clean, lower(text_clean) AS low FROM turns WHERE role = 'CUSTOMER')
SELECT conv_id, turn FROM t WHERE length(text_clean) < 90 OR regexp_matches(low, '{tx.DEICTIC}') OR regexp_matches(low, '{tx.ANGRY}') OR ({_rules_sql('low')})""")
def label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).where("role = 'CUSTOMER'").withColumn("text_clean", tx.clean_text(F.col("text")))
    return rows.where(tx.in_pool(F.col("text_clean"))).select("conv_id", "turn")


IDS_SQL = "ids AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN (c_custkey + 1) || ',' || (c_custkey + 2) WHEN 2 THEN 'n/a' WHEN 3 THEN NULL ELSE ' ' || c_custkey END AS ref FROM customer)"


@query("WITH " + IDS_SQL + r"""
SELECT id, (length(coalesce(ref, '')) - length(replace(coalesce(ref, ''), ',', '')))::BIGINT AS commas, regexp_matches(coalesce(ref, ''), '[0-9]') AS has_number, coalesce(trim(ref) = id::VARCHAR, false) AS is_self, regexp_full_match(coalesce(ref, ''), '\d+') AS all_digits FROM ids""")
def id_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    ref = F.when(key % 5 == 0, key.cast("string")).when(key % 5 == 1, F.concat_ws(",", key + 1, key + 2)).when(key % 5 == 2, "n/a").when(key % 5 == 3, F.lit(None)).otherwise(F.concat(F.lit(" "), key.cast("string")))
    return read(spark, sf_dir, "customer").select(key.alias("id"), tx.id_shape(ref, key).alias("s")).select("id", "s.*")


@query("WITH " + WINDOWED_SQL + """ SELECT conv_id, turn, text_clean || coalesce(chr(10) || nullif(array_to_string(list_reverse(before), ' | '), ''), '') AS intent_input,
  CASE WHEN len(before) > 0 THEN array_to_string(list_reverse(before), chr(10)) ELSE coalesce(previous_brand, '') END AS flat FROM w WHERE role = 'CUSTOMER'""")
def intent_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return rows.select("conv_id", "turn", tx.intent_input(F.col("text_clean"), cv.rendered_context(F.col("context"))).alias("intent_input"), tx.flat_context(F.col("context"), F.col("previous_brand")).alias("flat"))


@query("""SELECT event_id, user_id, epoch_us(min(ts) OVER (PARTITION BY user_id)) AS first_us FROM events""")
def group_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cv.with_start(read(spark, sf_dir, "events"), "user_id", "ts", "first_ts")
    return rows.select("event_id", "user_id", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"))


@query("WITH " + WINDOWED_SQL + """
SELECT w.conv_id, w.turn, next_brand AS reply, (SELECT min(b.turn) FROM turns b WHERE b.conv_id = w.conv_id AND b.role = 'BRAND' AND b.turn > w.turn) AS reply_at FROM w""")
def next_reply_with_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("text_clean", tx.clean_text(F.col("text")))
    found = cv.next_reply(rows, "conv_id", ["turn"], F.col("role") == "BRAND", F.col("text_clean"), F.col("turn"))
    return found.select("conv_id", "turn", F.col("next_brand.text").alias("reply"), F.col("next_brand.at").alias("reply_at"))


@query("WITH " + WINDOWED_SQL + " SELECT count(*) AS n_cases, count(*) FILTER (conv_id % 7 = 0) AS n_mismatches FROM w WHERE role = 'CUSTOMER'")
def case_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases checked against their turns, with a wrong reply planted in every seventh conversation."""
    reply = F.when(F.col("conv_id") % 7 == 0, F.lit("planted")).otherwise(F.nullif(F.trim("next_brand"), F.lit("")))
    made = corpus(spark, sf_dir).select("conv_id", "turn", reply.alias("brand_response"))
    return cv.reply_mismatches(made, turns(spark, sf_dir).withColumn("text_clean", tx.clean_text(F.col("text"))))


@query("SELECT lang AS a, source AS value, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents UNION SELECT 'nowhere') LEFT JOIN (SELECT lang AS l, source AS s, count(*) AS n FROM documents GROUP BY 1, 2) ON l = lang AND s = source")
def vocabulary_zero_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("a"), "source")
    names = d.select(F.col("source").alias("value")).distinct().union(spark.range(1).select(F.lit("nowhere").alias("value")))
    return stats.vocabulary_counts(d, "source", names, ["a"])


@query("SELECT count(*) AS n, count(*) FILTER (coalesce(text, '') = '') AS n_empty, round(avg(CASE WHEN text <> '' THEN length(text) END), 6) AS avg_chars FROM documents")
def output_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.output_sizes(read(spark, sf_dir, "documents"), "text").withColumn("avg_chars", F.round("avg_chars", 6))


LABELLED_SQL = "l AS (SELECT d.doc_id, lang AS gold, CASE WHEN d.doc_id % 3 = 0 THEN 'en' ELSE lang END AS pred, CASE WHEN d.doc_id % 2 = 0 THEN 1000 ELSE 2000 END AS size, source FROM labels JOIN documents d USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a made-up prediction and training size."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    pred = F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang"))
    return d.select("doc_id", F.col("lang").alias("gold"), pred.alias("pred"), F.when(F.col("doc_id") % 2 == 0, 1000).otherwise(2000).alias("size"), "source")


@query("WITH " + LABELLED_SQL + """, x AS (SELECT *, 'all' AS subset FROM l UNION ALL SELECT *, 'shared' FROM l WHERE gold IN ('en', 'de')), names AS (SELECT DISTINCT size, subset, gold AS label FROM x UNION SELECT DISTINCT size, subset, pred FROM x),
c AS (SELECT n.size, n.subset, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold = label) AS support, count(*) FILTER (pred = label) AS predicted FROM names n JOIN x ON x.size = n.size AND x.subset = n.subset GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM c)
SELECT size, subset, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f GROUP BY 1, 2""")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("en",), ("de",)], "label string")
    return me.learning_curve(_labelled(spark, sf_dir), "size", "gold", "pred", names)


@query("WITH " + LABELLED_SQL + " SELECT doc_id, gold, pred FROM l WHERE gold <> pred AND size = 1000 ORDER BY doc_id")
def misclassified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = me.sliced(_labelled(spark, sf_dir), size=1000)
    return me.misclassified(rows, "gold", "pred", "doc_id").select("doc_id", "gold", "pred")


@query("""WITH l AS (SELECT (quality = 1)::INTEGER AS a, CASE WHEN doc_id % 7 <> 0 THEN (quality = 1 OR doc_id % 5 = 0)::INTEGER END AS b, toxic AS o FROM labels)
SELECT count(*) AS n, round(avg(a), 6) AS rate, round(avg(b), 6) AS rate_again, round(avg(o), 6) AS rate_other, round(avg((a = b)::INTEGER), 6) AS self_agreement, round(avg((a = o)::INTEGER), 6) AS agreement, round(avg(a) - avg(o), 6) AS gap FROM l""")
def rater_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("o"))  # noqa: E741
    again = F.when(F.col("doc_id") % 7 != 0, F.col("a") | (F.col("doc_id") % 5 == 0))
    s = me.rater_summary(l.withColumn("b", again), "a", "b", "o")
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns if c != "n"])


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.latency(read(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", "n", F.round("avg", 6).alias("avg"), F.round("p95", 6).alias("p95"))


CODES_SQL = "c AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END, CASE WHEN lang = 'en' THEN 'english' END], lambda x: x IS NOT NULL) AS codes FROM documents)"


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.col("doc_id") % 2 == 0, "even"), F.when(F.col("lang") == "en", "english"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_compact(codes).alias("codes"))


@query("WITH " + CODES_SQL + " SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM c) GROUP BY code")
def code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.code_counts(_coded(spark, sf_dir), "codes")


@query("WITH " + CODES_SQL + " SELECT doc_id, len(codes)::INTEGER AS n_codes FROM c ORDER BY len(codes) DESC, doc_id LIMIT 40")
def most_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's first forty rows."""
    return stats.by_most_codes(_coded(spark, sf_dir), "codes", "doc_id").select("doc_id", F.size("codes").alias("n_codes")).limit(40)


@query("SELECT doc_id, lang FROM documents ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, doc_id LIMIT 40")
def named_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.in_named_order(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["de", "fr"], "doc_id").limit(40)


@query("""WITH s AS (SELECT 'a' AS s, doc_id FROM labels WHERE quality = 1 UNION SELECT 'b', doc_id FROM labels WHERE toxic = 1 UNION SELECT 'c', doc_id FROM documents WHERE doc_id % 2 = 0),
p AS (SELECT x.s AS a, y.s AS b, count(*) AS n FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.s < y.s GROUP BY 1, 2) SELECT v.a, v.b, coalesce(n, 0) AS n FROM (VALUES ('a', 'b'), ('a', 'c'), ('b', 'c')) v(a, b) LEFT JOIN p ON p.a = v.a AND p.b = v.b""")
def pairwise_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, d = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")  # noqa: E741
    return sampling.pairwise_overlaps({"a": l.where("quality = 1"), "b": l.where("toxic = 1"), "c": d.where("doc_id % 2 = 0")}, "doc_id")


#: Cases and their questions, their hashed vectors, and what is found under each question's time.
AGENT_SQL = "WITH " + WINDOWED_SQL + f""", c AS (SELECT conv_id * 1000 + pos_in_conv AS id, conv_id, text_clean AS message, nullif(trim(next_brand), '') AS reply FROM w WHERE role = 'CUSTOMER'),
tk AS (SELECT id, ('0x' || substr(md5(unnest({TOKENS.format('message')})), 1, 8))::BIGINT % {2 * agent.DIM} AS code FROM c),
dv AS (SELECT id, code % {agent.DIM} AS i, sum(CASE WHEN code < {agent.DIM} THEN 1.0 ELSE -1.0 END) AS v FROM tk GROUP BY 1, 2),
raw AS (SELECT c.id, list(coalesce(v, 0)::DOUBLE ORDER BY r.i) AS v FROM c CROSS JOIN (SELECT unnest(range({agent.DIM})) AS i) r LEFT JOIN dv ON dv.id = c.id AND dv.i = r.i GROUP BY 1),
vec AS (SELECT id, list_transform(v, lambda x: CASE WHEN list_sum(list_transform(v, lambda y: y * y)) > 0 THEN (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE ELSE 0 END) AS v FROM raw),
sc AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_sum(list_transform(list_zip(x.v, y.v), lambda z: z[1] * z[2])), 6) AS score FROM c q JOIN c d ON d.id <= q.id AND d.conv_id <> q.conv_id JOIN vec x ON x.id = q.id JOIN vec y ON y.id = d.id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 5)"""
REPLIES_SQL = """, e AS (SELECT query_id, avg(score) FILTER (rank <= 3) AS sim, bool_or(rank <= 3 AND reply IS NOT NULL) AS usable, arg_min(reply, rank) FILTER (reply IS NOT NULL) AS first_reply, count(*) AS n, count(reply) AS n_usable FROM h JOIN c ON c.id = h.doc_id GROUP BY 1)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as the agent takes them; ids grow with conversation and position, and stand for the time."""
    made = cv.cases(corpus(spark, sf_dir))
    number = F.col("conv_id") * 1000 + F.col("position_in_conversation")
    return made.select(number.alias("doc_id"), F.col("customer_message").alias("message"), number.alias("ts"), F.col("conv_id").cast("string").alias("group"), "brand_response", "language")


def _questions(cases: DataFrame) -> DataFrame:
    """Every case's message asks at its own time, and sees nothing of its own conversation."""
    return cases.select(F.col("doc_id").alias("query_id"), F.col("message").alias("text"), F.col("ts").alias("cutoff"), F.col("group").alias("exclude"))


@query(AGENT_SQL + " SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM h")
def agent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every customer turn finds among the earlier cases of other conversations."""
    cases = write_table(_cases(spark, sf_dir))
    return agent.Agent.of(cases).evidence(_questions(cases))


@query(AGENT_SQL + REPLIES_SQL + f""", i AS (SELECT c.id, message, first_reply, coalesce(n, 0) AS n, coalesce(n_usable, 0) AS n_usable, coalesce(usable, false) AS usable, coalesce(sim, 0) AS sim,
    CASE {" ".join(f"WHEN regexp_matches(lower(message), '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in tx.RUBRIC.items())} ELSE 'unmatched' END AS intent,
    CASE WHEN length(trim(replace(message, '@USER', ''))) < 8 THEN 0.2 ELSE 0.8 END AS p FROM c LEFT JOIN e ON e.query_id = c.id),
j AS (SELECT *, greatest(0, least(1, 0.6 * p + 0.4 * sim)) AS confidence, intent IN {policy.NO_INTENT} AS nothing, intent IN {policy.RISK_INTENTS} AS risky FROM i),
k AS (SELECT *, CASE WHEN nothing THEN 'no actionable intent' WHEN risky THEN 'high-risk category' WHEN n = 0 THEN 'no retrieval hits' WHEN NOT usable THEN 'no usable reply' WHEN sim < 0.02 THEN 'sim_mean' WHEN confidence < 0.45 THEN 'confidence' ELSE 'confident intent' END AS rule FROM j),
replies AS (SELECT id AS doc_id, first_reply AS text FROM k WHERE first_reply IS NOT NULL), {draft_parts('replies')}
SELECT id AS example_id, intent, CASE WHEN rule = 'confident intent' THEN 'auto_handle' ELSE 'escalate' END AS action, rule, round(sim, 4) AS sim_mean, round(confidence, 4)::DOUBLE AS action_confidence,
  CASE WHEN rule <> 'confident intent' THEN '{policy.opener("sorry", "").replace("'", "''")} {policy.ESCALATION.replace("'", "''")}' ELSE coalesce(drafts.draft, '{policy.opener("default", "").replace("'", "''")} {policy.NEXT_STEP.replace("'", "''")}') END AS draft,
  n::INTEGER AS n_evidence, n_usable::INTEGER AS n_usable FROM k LEFT JOIN drafts ON drafts.doc_id = id""")
def agent_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer turn answered by all parts: rules name the intent, earlier cases of other conversations are the evidence, the
    policy decides and drafts."""
    cases = write_table(_cases(spark, sf_dir))
    found = agent.Agent.of(cases).respond(_questions(cases))
    rule = F.regexp_extract(F.get("action_reasons", F.lit(0)), "(no actionable intent|high-risk category|no retrieval hits|no usable reply|sim_mean|confidence|confident intent)", 1)
    return found.select("example_id", "intent", "action", rule.alias("rule"), "sim_mean", "action_confidence", "draft", "n_evidence", "n_usable")


@query(None)
def agent_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a saved agent: a classifier fitted on what the rules say of the first half of the cases names the intents."""
    cases = write_table(_cases(spark, sf_dir))
    questions = _questions(cases)
    taught = questions.join(agent.rule_intents(questions).select("query_id", F.col("intent").alias("label")), "query_id")
    half = cases.agg(F.percentile_approx("ts", 0.5).alias("t")).first()["t"]
    classifier = ml.text_classifier(ml.with_ngrams(taught.where(F.col("cutoff") <= F.lit(half)).select("query_id", "text", "label")), balanced=True, min_df=1)
    path = f"{checkpoint_dir(spark)}/agent-{uuid.uuid4().hex}"
    agent.Agent.of(cases).save(path, classifier)
    return agent.Agent.load(spark, path, classified=True).respond(questions).drop("message")


CHAT_SQL = """WITH m AS (SELECT user_id AS session, event_id AS number, ts AS moment, CASE WHEN event_type = 'signup' THEN '/reset' ELSE event_type || ' ' || event_id END AS text FROM events),
g AS (SELECT *, CASE WHEN text = '/reset' OR coalesce(moment - lag(moment) OVER (PARTITION BY session ORDER BY moment, number) > INTERVAL 12 HOUR, false) THEN 1 ELSE 0 END AS anew FROM m),
p AS (SELECT *, sum(anew) OVER (PARTITION BY session ORDER BY moment, number) AS part FROM g),
t AS (SELECT session, number, row_number() OVER v AS turn, coalesce(string_agg(text, chr(10)) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context, text FROM p WHERE text <> '/reset' WINDOW v AS (PARTITION BY session, part ORDER BY moment, number))
SELECT session, number, turn::INTEGER AS turn, strftime(TIMESTAMP '2017-11-22 23:58:30' + to_minutes(turn), '%Y-%m-%d %H:%M:%S') AS clock, context, text FROM t"""


@query(CHAT_SQL)
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of one session a user: three runs of a stream, each resumed from the checkpoint of the one before."""
    e = read(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "signup", chat.RESET).otherwise(F.concat_ws(" ", "event_type", "event_id"))
    messages = e.select(F.col("user_id").cast("bigint").alias("session"), F.col("event_id").cast("bigint").alias("number"), F.col("ts").cast("timestamp").alias("at"), text.alias("text"))
    ends = messages.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    folder = f"{checkpoint_dir(spark)}/chat-{uuid.uuid4().hex}"
    for k in range(3):
        low, high = (ends["a"] + (ends["b"] - ends["a"]) / 3 * i for i in (k, k + 1))
        part = messages.where((F.col("at") >= F.lit(low)) & ((F.col("at") < F.lit(high)) | F.lit(k == 2)))
        part.write.mode("append").parquet(f"{folder}/messages")
        chat.run(spark, f"{folder}/messages", f"{folder}/state", f"{folder}/turns", datetime(2017, 11, 22, 23, 58, 30), idle="12 hours", partitions=8)
    found = spark.read.schema(chat.TURN).parquet(f"{folder}/turns")
    return found.withColumn("clock", F.date_format("clock", "yyyy-MM-dd HH:mm:ss"))


def _variant_sql(v: str) -> str:
    """CTEs with the first five hits of each model over one form of the cases k(id, msg, ctx)."""
    names = f"documents AS (SELECT id AS doc_id, {v} AS text FROM k), benchmark AS (SELECT id AS item_id, {v} AS text FROM k WHERE id % 50 = 0)"
    tfidf = TFIDF_SQL.removeprefix("WITH ").split(", z AS (")[0]
    return f"""bm_{v} AS (WITH {names}, {BM25_SQL} SELECT query_id, doc_id, score FROM bm), tf_{v} AS (WITH {names}, {tfidf} SELECT query_id, doc_id, score FROM tfidf),
tk_{v} AS (SELECT id, ('0x' || substr(md5(unnest({TOKENS.format(v)})), 1, 8))::BIGINT % 128 AS code FROM k),
dv_{v} AS (SELECT id, code % 64 AS i, sum(CASE WHEN code < 64 THEN 1.0 ELSE -1.0 END) AS v FROM tk_{v} GROUP BY 1, 2),
raw_{v} AS (SELECT k.id, list(coalesce(v, 0)::DOUBLE ORDER BY r.i) AS v FROM k CROSS JOIN (SELECT unnest(range(64)) AS i) r LEFT JOIN dv_{v} d ON d.id = k.id AND d.i = r.i GROUP BY 1),
vec_{v} AS (SELECT id, list_transform(v, lambda x: CASE WHEN list_sum(list_transform(v, lambda y: y * y)) > 0 THEN (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE ELSE 0 END) AS v FROM raw_{v}),
ds_{v} AS (SELECT x.id AS query_id, y.id AS doc_id, list_sum(list_transform(list_zip(x.v, y.v), lambda z: z[1] * z[2])) AS score FROM vec_{v} x, vec_{v} y WHERE x.id % 50 = 0),
bo_{v} AS (SELECT d.query_id, d.doc_id, d.score AS d, coalesce(s.score, 0) AS s FROM ds_{v} d LEFT JOIN bm_{v} s USING (query_id, doc_id)),
mm_{v} AS (SELECT *, min(d) OVER w AS d0, max(d) OVER w AS d1, min(s) OVER w AS s0, max(s) OVER w AS s1 FROM bo_{v} WINDOW w AS (PARTITION BY query_id)),
hy_{v} AS (SELECT query_id, doc_id, 0.5 * CASE WHEN d1 - d0 <= 1e-12 THEN 0.0 ELSE (d - d0) / (d1 - d0) END + 0.5 * CASE WHEN s1 - s0 <= 1e-12 THEN 0.0 ELSE (s - s0) / (s1 - s0) END AS score FROM mm_{v})"""


VARIANTS_SQL = "WITH " + WINDOWED_SQL + r""", k AS (SELECT conv_id * 1000 + pos_in_conv AS id, text_clean AS msg, coalesce(array_to_string(list_transform(list_filter(list_reverse(before), lambda t: trim(substr(t, strpos(t, ': ') + 2)) <> ''),
  lambda t: regexp_replace(regexp_replace(t, '^CUSTOMER: ', 'Previous customer: '), '^BRAND: ', 'Previous support: ')), chr(10)) || chr(10), '') || 'Current customer: ' || text_clean AS ctx FROM w WHERE role = 'CUSTOMER'), """ + _variant_sql("msg") + ", " + _variant_sql("ctx") + ", every AS (" + " UNION ALL ".join(
    f"SELECT '{m}/{v}' AS model, query_id, doc_id, round(score, 6) AS score FROM {t}_{v}" for v in ("msg", "ctx") for m, t in (("bm25", "bm"), ("tfidf", "tf"), ("dense", "ds"), ("hybrid", "hy"))
) + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, doc_id) AS rank FROM every QUALIFY rank <= 5),
pool AS (SELECT query_id, doc_id, string_agg(model, ',' ORDER BY model) AS sources, count(*) AS n_sources, min(rank)::INTEGER AS best_rank FROM ranked GROUP BY 1, 2)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY n_sources DESC, best_rank, doc_id))::INTEGER AS place FROM pool QUALIFY place <= 5"""


@query(VARIANTS_SQL)
def pooled_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of eight retrievers: four models over messages alone and with their context; messages whose id is divisible by 50 ask."""
    made = cv.cases(corpus(spark, sf_dir))
    number = F.col("conv_id") * 1000 + F.col("position_in_conversation")
    message, context = F.col("customer_message"), F.col("conversation_context")
    docs = write_table(made.select(number.alias("doc_id"), tx.document_text(message, context, False).alias("msg"), tx.document_text(message, context, True).alias("ctx")))
    retrievers = variants.Retrievers(docs, f"{checkpoint_dir(spark)}/variants-{uuid.uuid4().hex}", ("msg", "ctx"))
    retrievers.build()
    found = retrievers.pool(docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))
    names = F.array_join(F.array_sort(F.transform("sources", lambda s: s["model"])), ",")
    return found.select("query_id", "doc_id", names.alias("sources"), "n_sources", "best_rank", "place")
