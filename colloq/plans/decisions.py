"""Evaluation and hand-off queries: ``labels`` play two raters, ``events`` confidences, ``conversations`` answered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions import text as tx
from colloq.functions.language import detect_language
from colloq.operators import conversations as cv
from colloq.operators import metrics as me
from colloq.operators import ml, policy, sampling
from colloq.plans.conversations import WINDOWED_SQL, corpus
from colloq.plans.registry import query
from colloq.session import read, write_table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("expected"), (F.col("toxic") == 1).alias("predicted"))


TABLE_SQL = """round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6)::DOUBLE AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6)::DOUBLE AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6)::DOUBLE AS f1"""
COUNTS_SQL = "count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn"


@query(f"WITH l AS (SELECT quality = 0 AS e, toxic = 1 AS p FROM labels), c AS (SELECT {COUNTS_SQL} FROM l) SELECT tp, fp, fn, tn, {TABLE_SQL} FROM c")
def confusion2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.binary_confusion(_labels(spark, sf_dir), F.col("expected"), F.col("predicted"))


@query(f"WITH l AS (SELECT lang, quality = 0 AS e, toxic = 1 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, {COUNTS_SQL} FROM l GROUP BY lang) SELECT lang, tp, fp, fn, tn, {TABLE_SQL} FROM c")
def per_group_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return me.binary_confusion(rows, F.col("expected"), F.col("predicted"), ["lang"])


@query(f"""WITH l AS (SELECT quality = 0 AS e, toxic = 1 AS t, n_chars < 500 AS s FROM labels JOIN documents USING (doc_id)), x AS (SELECT 'always_auto' AS policy, e, false AS p FROM l UNION ALL SELECT 'always_escalate', e, true FROM l UNION ALL SELECT 'toxic', e, t FROM l UNION ALL SELECT 'toxic_or_short', e, t OR s FROM l),
c AS (SELECT policy, {COUNTS_SQL} FROM x GROUP BY policy) SELECT policy, tp, fp, fn, tn, {TABLE_SQL} FROM c""")
def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rules = {"always_auto": F.lit(False), "always_escalate": F.lit(True), "toxic": F.col("predicted"), "toxic_or_short": F.col("predicted") | (F.col("n_chars") < 500)}
    return me.policies(rows, F.col("expected"), rules)


def _confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("confidence"), (F.col("event_type") == "purchase").alias("correct"))


@query("""WITH b AS (SELECT least(floor(value / 500 * 5), 4) AS bin, count(*) AS n, avg(value / 500) AS mc, avg((event_type = 'purchase')::INTEGER) AS my FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1) SELECT round(sum(n * abs(mc - my)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b""")
def ece5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.expected_calibration_error(_confidences(spark, sf_dir), F.col("confidence"), F.col("correct")).withColumn("ece", F.round("ece", 6))


@query("""WITH e AS (SELECT value / 500 AS c, (event_type = 'purchase')::INTEGER AS y FROM events), q AS (SELECT quantile_cont(c, [0.2, 0.4, 0.6, 0.8]) AS q FROM e)
SELECT (CASE WHEN c < q[1] THEN 0 WHEN c < q[2] THEN 1 WHEN c < q[3] THEN 2 WHEN c < q[4] THEN 3 ELSE 4 END)::INTEGER AS bucket, count(*) AS n, round(avg(c), 6) AS mean_confidence, round(avg(y), 6) AS accuracy FROM e, q GROUP BY 1""")
def quantile_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = me.calibration_table(_confidences(spark, sf_dir), F.col("confidence"), F.col("correct"))
    return t.select("bucket", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT max(CASE WHEN i = floor(0.95 * (n - 1)) THEN value END) AS floor_index, max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN value END) AS rounded_index, round(quantile_cont(value, 0.95), 6) AS interpolated FROM r""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.order_statistics(read(spark, sf_dir, "events"), "value", 0.95).withColumn("interpolated", F.round("interpolated", 6))


@query("""WITH l AS (SELECT (quality = 0)::INTEGER AS a, toxic::INTEGER AS b FROM labels), o AS (SELECT count(*) AS n, avg((a = b)::INTEGER) AS po, avg(a) AS pa, avg(b) AS pb FROM l)
SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM o""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.kappa(_labels(spark, sf_dir), F.col("expected"), F.col("predicted")).select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("SELECT count(*) AS n, round(avg((l.quality = 1)::INTEGER), 6) AS good_rate, round(avg((l.toxic = 1)::INTEGER), 6) AS toxic_rate FROM documents d LEFT JOIN labels l USING (doc_id)")
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    s = me.agreement_summary(rows, ["good", "toxic"])
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("good_rate", "toxic_rate")])


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer turns with an intent, a probability and evidence derived from their position: inputs of the policy."""
    c = corpus(spark, sf_dir)
    intent = F.when(F.col("turn") % 5 == 0, "delivery_delay").when(F.col("turn") % 5 == 1, "order_status_query").when(F.col("turn") % 5 == 2, "refund_request").when(F.col("turn") % 5 == 3, "none").otherwise("device_app_issue")
    hit = lambda score, reply: F.struct(score.alias("score"), reply.alias("brand_response"), F.lit("en").alias("language"))
    base = (F.col("conv_id") % 10) / 10.0
    hits = F.array_compact(F.array(F.when(F.col("conv_id") % 9 > 0, hit(base, F.col("next_brand"))), F.when(F.col("conv_id") % 9 > 1, hit(base / 2, F.col("previous_brand"))), F.when(F.col("conv_id") % 9 > 2, hit(base / 4, F.lit(None).cast("string")))))
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("example_id"), "conv_id", "turn", intent.alias("intent"), ((F.col("conv_id") * 7 + F.col("turn")) % 100 / 100.0).alias("p"), hits.alias("hits"))


ANSWERED_SQL = "WITH " + WINDOWED_SQL + """, a AS (SELECT conv_id, turn, conv_id || ':' || turn AS example_id, CASE turn % 5 WHEN 0 THEN 'delivery_delay' WHEN 1 THEN 'order_status_query' WHEN 2 THEN 'refund_request' WHEN 3 THEN 'none' ELSE 'device_app_issue' END AS intent,
  ((conv_id * 7 + turn) % 100) / 100 AS p, (conv_id % 10) / 10 AS base, conv_id % 9 AS k, next_brand, previous_brand FROM w WHERE role = 'CUSTOMER'),
s AS (SELECT *, CASE WHEN k = 0 THEN 0.0 WHEN k = 1 THEN base WHEN k = 2 THEN (base + base / 2) / 2 ELSE (base + base / 2 + base / 4) / 3 END AS sim, (k > 0 AND coalesce(next_brand, '') <> '') OR (k > 1 AND coalesce(previous_brand, '') <> '') AS usable FROM a),
c AS (SELECT *, greatest(0, least(1, 0.6 * p + 0.4 * sim)) AS confidence FROM s),
d AS (SELECT *, intent = 'none' AS no_intent, intent = 'refund_request' AS risky, k = 0 AS no_hits, sim < 0.02 AS far FROM c)"""


@query(ANSWERED_SQL + """ SELECT example_id, CASE WHEN no_intent OR risky OR no_hits OR NOT usable OR far OR confidence < 0.45 THEN 'escalate' ELSE 'auto_handle' END AS action,
  CASE WHEN no_intent THEN 'no actionable intent' WHEN risky THEN 'high-risk category' WHEN no_hits THEN 'no retrieval hits' WHEN NOT usable THEN 'no usable reply' WHEN far THEN 'sim_mean' WHEN confidence < 0.45 THEN 'confidence' ELSE 'confident intent' END AS rule,
  round(sim, 6)::DOUBLE AS sim_mean, round(confidence, 6)::DOUBLE AS confidence FROM d""")
def escalation_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _answered(spark, sf_dir).select("example_id", policy.decide(F.col("intent"), F.col("p"), F.col("hits")).alias("d"))
    rule = F.regexp_extract("d.reason", "(no actionable intent|high-risk category|no retrieval hits|no usable reply|sim_mean|confidence|confident intent)", 1)
    return d.select("example_id", "d.action", rule.alias("rule"), F.round("d.sim_mean", 6).alias("sim_mean"), F.round("d.confidence", 6).alias("confidence"))


@query(ANSWERED_SQL + """, f AS (SELECT unnest([0.2::DOUBLE, 0.45::DOUBLE, 0.7::DOUBLE]) AS floor) SELECT floor, count(*) AS n, count(*) FILTER (no_intent OR risky OR no_hits OR NOT usable OR far OR confidence < floor) AS n_escalated,
  round(avg((no_intent OR risky OR no_hits OR NOT usable OR far OR confidence < floor)::INTEGER), 6) AS rate FROM d, f GROUP BY floor""")
def sensitivity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.sweep(_answered(spark, sf_dir), [0.2, 0.45, 0.7]).withColumn("rate", F.round("rate", 6))


@query(ANSWERED_SQL + """, x AS (SELECT *, CASE WHEN conv_id % 4 = 0 THEN 'delivery_delay' ELSE intent END AS truth, CASE WHEN conv_id % 3 = 0 THEN ['none'] ELSE []::VARCHAR[] END AS secondary, CASE WHEN no_intent OR risky OR no_hits OR NOT usable OR far OR confidence < 0.45 THEN 'escalate' ELSE 'auto_handle' END AS action,
  CASE WHEN k > 0 THEN list_distinct(list_filter(regexp_extract_all(lower(next_brand), '[a-z]{5,}'), lambda w: NOT regexp_matches(w, '^(http|tco)'))) END AS words_next,
  CASE WHEN k > 1 THEN list_distinct(list_filter(regexp_extract_all(lower(previous_brand), '[a-z]{5,}'), lambda w: NOT regexp_matches(w, '^(http|tco)'))) END AS words_previous FROM d)
SELECT example_id, concat_ws(';', CASE WHEN intent <> truth AND list_contains(secondary, intent) THEN 'intent_close_secondary' END, CASE WHEN intent <> truth AND NOT list_contains(secondary, intent) AND intent = 'none' THEN 'intent_predicted_none' END,
  CASE WHEN intent <> truth AND NOT list_contains(secondary, intent) AND intent <> 'none' THEN 'intent_off_target' END, CASE WHEN action = 'escalate' AND p >= 0.3 AND usable AND sim >= 0.12 THEN 'escalation_conservative' END,
  CASE WHEN action = 'auto_handle' AND (NOT usable OR sim < 0.12) THEN 'escalation_false_auto' END, CASE WHEN action = 'auto_handle' AND (turn % 2 = 0 OR NOT (coalesce(len(words_next), 0) >= 2 OR coalesce(len(words_previous), 0) >= 2)) THEN 'drafting_ungrounded' END, CASE WHEN conv_id % 2 = 0 AND k > 0 THEN 'retrieval_lang_mismatch' END) AS codes FROM x""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answered(spark, sf_dir).withColumn("action", policy.decide(F.col("intent"), F.col("p"), F.col("hits"))["action"]).withColumns(
        {
            "true_intent": F.when(F.col("conv_id") % 4 == 0, "delivery_delay").otherwise(F.col("intent")),
            "secondary_intents": F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>")),
            "intent_prob": F.col("p"),
            "draft": F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.concat_ws(" ", "hits.brand_response")),
            "language": F.when(F.col("conv_id") % 2 == 0, "de").otherwise("en"),
        }
    )
    return rows.select("example_id", F.array_join(policy.error_codes(rows), ";").alias("codes"))


@query(None)
def agent_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision, draft and evidence of every customer turn."""
    return policy.respond(_answered(spark, sf_dir)).drop("hits")


@query(None)
def kmeans_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.clusters(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), k=10)


@query("SELECT doc_id, quality, toxic, length(text)::BIGINT AS n FROM documents JOIN labels USING (doc_id) WHERE trim(coalesce(text, '')) <> ''")
def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ml.labelled_corpus(read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return rows.select("doc_id", "quality", "toxic", F.length("text").cast("long").alias("n"))


@query(None)
def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language classifier fitted on the documents that have labels says what all documents are."""
    rows = ml.with_ngrams(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    labelled = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    return ml.weak_labels(ml.text_classifier(rows.join(labelled, "id"), iterations=1200, min_df=1), rows)


@query(None)
def baseline_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority, logistic and SVC baselines of a message's language, from the message alone and with its context: fitted on 70 % of the
    conversations, predicted for the others."""
    c = corpus(spark, sf_dir)
    both = c.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text_clean").alias("message"), tx.intent_input(F.col("text_clean"), cv.rendered_context(F.col("context"))).alias("message_context"))
    rows = both.withColumn("label", detect_language(F.col("message")))
    parts = write_table(sampling.split_groups(rows, "conv_id", {"train": 0.7, "test": 0.3}, sampling.portable_hash(F.col("conv_id"))))
    return ml.baseline_grid(parts.where("split = 'train'"), parts.where("split = 'test'"), ["message", "message_context"])
