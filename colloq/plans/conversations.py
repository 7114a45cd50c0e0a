"""Conversation queries over the ``conversations`` table: user is the customer, assistant the brand, system turns are neither."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions import text as tx
from colloq.operators import conversations as cv
from colloq.operators import graph, stats
from colloq.plans.registry import query
from colloq.session import read

#: The SQL of the message table all these queries start from.
TURNS_SQL = r"""turns AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'CUSTOMER' ELSE 'BRAND' END AS role, text,
    trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', 'URL', 'g'), '@[\p{L}\p{N}_]+', '@USER', 'g'), '\s+', ' ', 'g')) AS text_clean
  FROM conversations WHERE role <> 'system')"""
WINDOWED_SQL = (
    TURNS_SQL
    + """,
w AS (SELECT *, (row_number() OVER c - 1)::INTEGER AS pos_in_conv, (count(*) OVER (PARTITION BY conv_id))::INTEGER AS conv_length,
    list(role || ': ' || text_clean) OVER (c ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before,
    last_value(CASE WHEN role = 'BRAND' THEN text_clean END IGNORE NULLS) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_brand,
    first_value(CASE WHEN role = 'BRAND' THEN text_clean END IGNORE NULLS) OVER (c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_brand
  FROM turns WINDOW c AS (PARTITION BY conv_id ORDER BY turn))"""
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "conversations").where(F.col("role") != "system")
    return raw.select("conv_id", "turn", cv.role_of(F.col("role") == "user").alias("role"), "text")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).withColumn("text_clean", tx.clean_text(F.col("text")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.customer_corpus(turns(spark, sf_dir))


@query("WITH " + WINDOWED_SQL + """ SELECT conv_id, turn, pos_in_conv, conv_length, text AS customer_text, text_clean,
  coalesce(array_to_string(list_reverse(before), ' | '), '') AS conversation_context, previous_brand, next_brand FROM w WHERE role = 'CUSTOMER'""")
def customer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return rows.select("conv_id", "turn", "pos_in_conv", "conv_length", F.col("text").alias("customer_text"), "text_clean", cv.rendered_context(F.col("context")).alias("conversation_context"), "previous_brand", "next_brand")


@query("WITH " + WINDOWED_SQL + " SELECT conv_id, turn, pos_in_conv, conv_length FROM w")
def conv_position_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.with_position(turns(spark, sf_dir), "conv_id", ["turn"]).select("conv_id", "turn", "pos_in_conv", "conv_length")


@query("WITH " + WINDOWED_SQL + " SELECT conv_id, turn, role, coalesce(array_to_string(list_reverse(before), ' | '), '') AS context FROM w")
def conv_context6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cv.with_context(_cleaned(spark, sf_dir), "conv_id", ["turn"])
    return rows.select("conv_id", "turn", "role", cv.rendered_context(F.col("context")).alias("context"))


@query("WITH " + WINDOWED_SQL + " SELECT conv_id, turn, previous_brand, next_brand FROM w")
def brand_reply_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cv.with_replies(_cleaned(spark, sf_dir), "conv_id", ["turn"], F.col("role") == "BRAND", F.col("text_clean"))
    return rows.select("conv_id", "turn", "previous_brand", "next_brand")


@query("WITH " + TURNS_SQL + """ SELECT conv_id, CASE WHEN bool_or(role = 'CUSTOMER') AND bool_or(role <> 'CUSTOMER') THEN 'mixed' WHEN bool_or(role = 'CUSTOMER') THEN 'customer_only' ELSE 'brand_only' END AS composition
  FROM turns GROUP BY conv_id""")
def conv_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.composition(turns(spark, sf_dir), "conv_id", F.col("role") == "CUSTOMER")


@query("SELECT size, count(*) AS n_groups FROM (SELECT conv_id, count(*) AS size FROM conversations GROUP BY conv_id) GROUP BY size")
def conv_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_histogram(read(spark, sf_dir, "conversations"), "conv_id")


@query("""SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_size, quantile_cont(n, 0.5)::DOUBLE AS median_size, quantile_cont(n, 0.9)::DOUBLE AS p90_size, max(n) AS max_size
  FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)""")
def conv_size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_summary(read(spark, sf_dir, "conversations"), "conv_id").withColumn("mean_size", F.round("mean_size", 6))


@query("WITH " + WINDOWED_SQL + r""" SELECT conv_id, turn, coalesce(array_to_string(list_transform(list_reverse(before), lambda t: regexp_replace(regexp_replace(t, '^CUSTOMER: ', 'Previous customer: '), '^BRAND: ', 'Previous support: ')), chr(10)) || chr(10), '')
  || 'Current customer: ' || text_clean AS document FROM w WHERE role = 'CUSTOMER'""")
def serialize_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("conv_id", "turn", tx.context_and_message(F.col("text_clean"), F.col("context")).alias("document"))


@query("WITH " + WINDOWED_SQL + """ SELECT conv_id, turn, coalesce(len(before), 0)::BIGINT AS n_turns, coalesce(array_to_string(list_reverse(before), ' | '), '') AS context FROM w""")
def parse_context_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cv.with_context(_cleaned(spark, sf_dir), "conv_id", ["turn"])
    again = tx.parse_context(cv.rendered_context(F.col("context")))
    return rows.select("conv_id", "turn", again.alias("p")).select("conv_id", "turn", F.size("p").cast("long").alias("n_turns"), cv.rendered_context(F.col("p")).alias("context"))


@query("WITH " + TURNS_SQL + """, f AS (SELECT conv_id, turn, role, replace(text, chr(10), ' ') AS t FROM turns)
SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(t) > 260 THEN substr(t, 1, 260) || '…' ELSE t END, chr(10) ORDER BY turn) AS transcript FROM f GROUP BY conv_id""")
def conv_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.transcript(turns(spark, sf_dir), "conv_id", ["turn"])


@query("WITH " + TURNS_SQL + """, f AS (SELECT conv_id, turn, role, replace(text, chr(10), ' ') AS t FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3)
SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || '…' ELSE t END, chr(10) ORDER BY turn) AS transcript FROM f GROUP BY conv_id""")
def transcript_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three turns of each conversation, longer excerpts."""
    return cv.transcript(turns(spark, sf_dir), "conv_id", ["turn"], limit=400, head=3)


@query("WITH " + WINDOWED_SQL + r""" SELECT conv_id, turn, coalesce(array_to_string(list_transform(list_filter(list_reverse(before), lambda t: trim(substr(t, strpos(t, ': ') + 2)) <> ''),
  lambda t: regexp_replace(regexp_replace(t, '^CUSTOMER: ', 'Previous customer:' || chr(10)), '^BRAND: ', 'Previous support:' || chr(10))), chr(10) || chr(10)) || chr(10) || chr(10), '') || 'Current customer:' || chr(10) || text_clean AS document FROM w WHERE role = 'CUSTOMER'""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("conv_id", "turn", tx.context_blocks(F.col("text_clean"), F.col("context")).alias("document"))


TEMPLATE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), 'https?://\S+', 'URL', 'g'), '@[\p{{L}}\p{{N}}_]+', '@USER', 'g'), '[0-9][0-9.,-]*', '#', 'g'), '[^\p{{L}}\p{{N}}_\s@#-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("WITH " + WINDOWED_SQL + ", c AS (SELECT *, nullif(trim(next_brand), '') AS reply FROM w WHERE role = 'CUSTOMER'), t AS (SELECT *, CASE WHEN reply IS NOT NULL THEN " + TEMPLATE_SQL.format("reply") + """ END AS template_key FROM c)
SELECT conv_id || ':' || pos_in_conv AS case_id, conv_id, pos_in_conv AS position_in_conversation, conv_length, text_clean AS customer_message, reply AS brand_response, reply IS NOT NULL AS has_usable_response, template_key,
  CASE WHEN template_key IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY template_key) END AS template_count,
  CASE WHEN template_key IS NULL THEN false ELSE count(*) OVER (PARTITION BY template_key) >= 20 END AS is_canned_template FROM t""")
def case_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cv.cases(corpus(spark, sf_dir))
    return made.select("case_id", "conv_id", "position_in_conversation", "conv_length", "customer_message", "brand_response", "has_usable_response", "template_key", "template_count", "is_canned_template")


@query("WITH " + WINDOWED_SQL + """, c AS (SELECT *, nullif(trim(next_brand), '') AS reply FROM w WHERE role = 'CUSTOMER')
SELECT count(*) AS n_cases, count(DISTINCT conv_id) AS n_conversations, round(100 * avg((reply IS NOT NULL)::INTEGER), 2) AS pct_usable,
  round(100 * avg((length(trim(replace(text_clean, '@USER', ''))) < 8)::INTEGER), 2) AS pct_low_content, count(*) - (SELECT count(*) FROM (SELECT DISTINCT conv_id, text_clean FROM c)) AS n_repeated_messages,
  round(100 * avg((before IS NOT NULL AND len(before) > 0)::INTEGER), 2) AS pct_with_context, round(avg(conv_length), 6) AS avg_conv_length, quantile_cont(conv_length, 0.5)::DOUBLE AS median_conv_length FROM c""")
def corpus_forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cv.forensics(cv.cases(corpus(spark, sf_dir)))
    return f.select("n_cases", "n_conversations", "pct_usable", "pct_low_content", "n_repeated_messages", "pct_with_context", F.round("avg_conv_length", 6).alias("avg_conv_length"), "median_conv_length")


@query("WITH " + WINDOWED_SQL + ", c AS (SELECT nullif(trim(next_brand), '') AS reply FROM w WHERE role = 'CUSTOMER'), t AS (SELECT " + TEMPLATE_SQL.format("reply") + " AS name FROM c WHERE reply IS NOT NULL) SELECT name, count(*) AS n FROM t GROUP BY name ORDER BY n DESC, name LIMIT 10")
def forensic_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's ten commonest reply templates."""
    return cv.forensic_tables(cv.cases(corpus(spark, sf_dir)))["templates"]


@query("WITH " + WINDOWED_SQL + """ SELECT conv_id || ':' || pos_in_conv AS case_id, coalesce(len(before), 0)::BIGINT AS n_context, text_clean AS doc_msg, (nullif(trim(next_brand), '') IS NOT NULL) AS has_response FROM w WHERE role = 'CUSTOMER'""")
def slim_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = cv.from_slim(cv.slim(cv.cases(corpus(spark, sf_dir))))
    return again.select("case_id", F.size("conversation_context").cast("long").alias("n_context"), "doc_msg", F.element_at("metadata", "has_response").alias("has_response"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply table out of the turns: each turn answers the one before it."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return t.withColumn("parent", F.when(F.col("turn") > 0, F.col("id") - 1))


REPLIES_SQL = "m AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations)"


@query("WITH " + REPLIES_SQL + " SELECT id AS src, parent AS dst FROM m WHERE parent IN (SELECT id FROM m)")
def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reply_edges(_messages(spark, sf_dir), "id", "parent")


@query("WITH " + REPLIES_SQL + " SELECT id AS node, min(id) OVER (PARTITION BY conv_id) AS component FROM m")
def conversation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.conversations(_messages(spark, sf_dir), "id", "parent")


@query("WITH " + REPLIES_SQL + " SELECT id AS node, conv_id * 1000 AS root, turn AS depth, false AS cyclic FROM m WHERE turn > 0")
def chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chain_roots(graph.reply_edges(_messages(spark, sf_dir), "id", "parent"))


@query("WITH " + REPLIES_SQL + """ SELECT count(*) AS n_messages, count(parent) AS n_replies, count(*) FILTER (parent IN (SELECT id FROM m)) AS n_found, count(*) FILTER (parent = id) AS n_self FROM m""")
def edge_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    known = m.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return m.join(known, "parent", "left").agg(F.count("*").alias("n_messages"), F.count("parent").alias("n_replies"), F.count("known").alias("n_found"), F.count_if(F.col("parent") == F.col("id")).alias("n_self"))


@query("""SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')""")
def semi_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.touched_by(read(spark, sf_dir, "conversations"), "conv_id", F.col("role") == "system").select("conv_id", "turn")
