"""Text queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions import text as tx
from colloq.functions.language import LEXICON, TOKEN, detect_language
from colloq.operators import conversations as cv
from colloq.operators import metrics, policy, stats
from colloq.plans.conversations import TEMPLATE_SQL
from colloq.plans.registry import query
from colloq.session import read


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def _hits_sql(column: str, patterns: dict[str, str]) -> str:
    return ", ".join(f"regexp_matches(coalesce({column}, ''), '(?i){p.replace(chr(39), chr(39) * 2)}') AS {k}" for k, p in patterns.items())


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', 'URL', 'g'), '@[\p{L}\p{N}_]+', '@USER', 'g'), '\s+', ' ', 'g')) AS text_clean FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("text_clean"))


@query("SELECT doc_id, " + TEMPLATE_SQL.format("text") + " AS template FROM documents")
def canonical_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.canonical_template(F.col("text")).alias("template"))


@query("WITH t AS (SELECT doc_id, " + TEMPLATE_SQL.format("text") + " AS template_key FROM documents) SELECT doc_id, count(*) OVER (PARTITION BY template_key) AS template_count, count(*) OVER (PARTITION BY template_key) >= 3 AS is_canned_template FROM t")
def template_counts_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", tx.canonical_template(F.col("text")).alias("template_key"))
    return cv.with_template_counts(rows, canned_at=3).select("doc_id", "template_count", "is_canned_template")


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), 'https?://\S+|t\.co/\S+', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\+?[0-9][0-9\s().-]{7,}[0-9]', '', 'g'), '\b[0-9]{13,17}\b', '', 'g'), '@[\p{L}\p{N}_]+', '', 'g'), '\^[A-Za-z0-9]+', '', 'g') AS t FROM a)
SELECT doc_id, regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^[ .,;-]+|[ .,;-]+$', '', 'g') AS sanitized FROM b""")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.sanitize(F.col("text")).alias("sanitized"))


def _cue_sql() -> str:
    case = " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{name}'" for name, words in tx.CUES.items())
    return f"WITH l AS (SELECT doc_id, lower(text) AS low, text FROM documents) SELECT doc_id, CASE {case} ELSE 'default' END AS cue FROM l"


@query(_cue_sql())
def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.cue(F.col("text")).alias("cue"))


def _cue_set_sql() -> str:
    flags = {"apology": None, "ask": None, "contact": None}
    parts = [f"CASE WHEN {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in tx.CUE_FEATURES[k])} THEN '{k}' END" for k in flags]
    parts.insert(3, "CASE WHEN contains(text, '@') AND contains(text, '.') AND NOT starts_with(low, '@user') THEN 'email' END")
    parts.append("CASE WHEN contains(low, 'http') THEN 'url' END")
    return f"WITH l AS (SELECT doc_id, lower(text) AS low, text FROM documents) SELECT doc_id, concat_ws(',', {', '.join(parts)}) AS cue_set FROM l"


@query(_cue_set_sql())
def cue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(tx.cue_set(F.col("text")), ",").alias("cue_set"))


@query("WITH h AS (SELECT doc_id, text, " + _hits_sql("text", tx.PATTERNS) + """ FROM documents)
SELECT doc_id, trim(text) <> '' AS has_response, asks_dm, any_url AS contains_any_url, any_url AND help_context AS contains_help_url, any_url AND support_link_context AS contains_support_link, tracking AS contains_tracking_url,
  phone AS contains_phone, instruction AS contains_instruction, apology AS contains_apology, acknowledgement AS contains_acknowledgement, account_privacy AS account_or_privacy, resolved_claim AS claims_resolved FROM h""")
def response_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in tx.response_flags(F.col("text")).items()])


@query("SELECT doc_id, length(trim(replace(text, '@USER', ''))) < 8 AS is_low_content, length(text) < 90 AS is_short, regexp_matches(lower(text), '" + tx.DEICTIC + "') AS is_deictic, regexp_matches(lower(text), '" + tx.ANGRY + "') AS is_angry FROM documents")
def message_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", tx.is_low_content(F.col("text")).alias("is_low_content"), *[c.alias(k) for k, c in tx.message_flags(F.col("text")).items()])


@query(r"""SELECT lang, count(*) AS n, round(100 * avg(regexp_matches(text, 'https?://')::INTEGER), 2) AS pct_url, round(100 * avg(regexp_matches(text, '@[\p{L}\p{N}_]+')::INTEGER), 2) AS pct_mention,
  round(100 * avg(regexp_matches(text, '#[\p{L}\p{N}_]+')::INTEGER), 2) AS pct_hashtag, round(100 * avg(regexp_matches(text, '[^\x00-\x7F]')::INTEGER), 2) AS pct_non_ascii, round(100 * avg(regexp_matches(text, '(^|[^\p{L}\p{N}_])[A-Z]{3,}($|[^\p{L}\p{N}_])')::INTEGER), 2) AS pct_caps,
  min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 6) AS avg_length FROM documents GROUP BY lang""")
def quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rates = {"url": "https?://", "mention": r"@[\p{L}\p{N}_]+", "hashtag": r"#[\p{L}\p{N}_]+", "non_ascii": r"[^\x00-\x7F]", "caps": r"(^|[^\p{L}\p{N}_])[A-Z]{3,}($|[^\p{L}\p{N}_])"}
    n = F.length(t).cast("long")
    return docs(spark, sf_dir, "lang", "text").groupBy("lang").agg(F.count("*").alias("n"), *[stats.percent(t.rlike(p)).alias(f"pct_{k}") for k, p in rates.items()], F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n), 6).alias("avg_length"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_''-]+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\p{Nd}+$')) AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM t""")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(r"""SELECT doc_id, md5(lower(regexp_replace(coalesce(text, ''), 'https?://\S+|@[\p{L}\p{N}_]+|#', ' ', 'g'))) AS normalised_md5,
  len(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: regexp_full_match(w, '[\p{L}\p{N}]+') AND length(w) > 3)))::BIGINT AS n_loose,
  len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}') AND w NOT IN ('the', 'and', 'der', 'que')))::BIGINT AS n_forensic FROM documents""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without links, mentions and hashes; their loose words; their plain words without stop words."""
    t = F.col("text")
    plain = tx.forensic_tokens(t, ("the", "and", "der", "que"))
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.normalised(t)).alias("normalised_md5"), F.size(tx.loose_words(t)).cast("long").alias("n_loose"), F.size(plain).cast("long").alias("n_forensic"))


RULES_SQL = "r AS (SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}') AS {k}" for k, p in tx.RUBRIC.items()) + " FROM documents)"


@query("WITH " + RULES_SQL + " SELECT doc_id, " + " + ".join(f"{k}::BIGINT" for k in tx.RUBRIC) + " AS n_hits, CASE " + " ".join(f"WHEN {k} THEN '{k}'" for k in tx.RUBRIC) + " ELSE 'unmatched' END AS bucket FROM r")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(tx.rubric_hits(F.col("text"))).cast("long").alias("n_hits"), tx.rubric_bucket(F.col("text")).alias("bucket"))


@query("""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '(the|and|for|with|from|that|this)')) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS x FROM w)
SELECT a.x AS a, b.x AS b, count(*) AS n FROM e a JOIN e b USING (doc_id) GROUP BY 1, 2""")
def rule_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(the|and|for|with|from|that|this)"), 0))
    return stats.cooccurrence(docs(spark, sf_dir).select("doc_id", hits.alias("labels")), "doc_id", "labels")


def _language_sql() -> str:
    quoted = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    counts = ", ".join(f"len(list_filter(t, lambda x: list_contains({quoted(v)}, x))) AS {k}_" for k, v in LEXICON.items())
    case = " ".join(f"WHEN best > 0 AND {k}_ = best THEN '{k}'" for k in LEXICON)
    token = TOKEN.replace("'", "''")
    return (
        f"l AS (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '{token}') AS t FROM documents), c AS (SELECT doc_id, lang, text, len(t) AS n, {counts} FROM l), "
        f"b AS (SELECT *, greatest({', '.join(k + '_' for k in LEXICON)}) AS best FROM c), "
        f"p AS (SELECT doc_id, lang, CASE WHEN trim(text) = '' OR n = 0 THEN 'unknown' {case} WHEN regexp_matches(text, '[\\x00-\\x7F]') THEN 'en' ELSE 'other' END AS detected FROM b)"
    )


LANGUAGE_SQL = _language_sql()


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "doc_id", "lang", "text").select("doc_id", "lang", detect_language(F.col("text")).alias("detected"))


@query("WITH " + LANGUAGE_SQL + " SELECT doc_id, detected FROM p")
def detect_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("doc_id", "detected")


@query("WITH " + LANGUAGE_SQL + " SELECT lang, count(*) FILTER (detected = 'de') AS de, count(*) FILTER (detected = 'en') AS en, count(*) FILTER (detected = 'es') AS es, count(*) FILTER (detected = 'fr') AS fr FROM p GROUP BY lang")
def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_languages(spark, sf_dir), "lang", "detected", ["de", "en", "es", "fr"])


CLASSES_SQL = """k AS (SELECT unnest(['g', 'd']) AS side, * FROM p), s AS (SELECT CASE side WHEN 'g' THEN lang ELSE detected END AS label, sum((side = 'g' AND lang = detected)::INTEGER)::BIGINT AS tp,
  sum((side = 'g')::INTEGER)::BIGINT AS support, sum((side = 'd')::INTEGER)::BIGINT AS predicted FROM k GROUP BY 1),
f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM s)"""


@query("WITH " + LANGUAGE_SQL + ", " + CLASSES_SQL + " SELECT label, tp, support, predicted, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM f")
def lang_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.class_metrics(_languages(spark, sf_dir), "lang", "detected")
    return m.select("label", "tp", "support", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH " + LANGUAGE_SQL + ", " + CLASSES_SQL + """ SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6)::DOUBLE AS accuracy, round(avg(f1), 6)::DOUBLE AS macro_f1, round(avg(precision), 6)::DOUBLE AS macro_precision,
  round(avg(recall), 6)::DOUBLE AS macro_recall, round(sum(f1 * support) / sum(support), 6)::DOUBLE AS weighted_f1 FROM f""")
def lang_f1_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_summary(_languages(spark, sf_dir), "lang", "detected")


@query("WITH " + LANGUAGE_SQL + " SELECT lang, detected, count(*) AS n FROM p WHERE lang <> detected GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_confusions(_languages(spark, sf_dir), "lang", "detected")


def draft_parts(table: str) -> str:
    """CTEs that end in drafts(doc_id, draft) for the replies of table(doc_id, text)."""
    low = "lower(text)"
    sorry = " OR ".join(f"contains({low}, '{w}')" for w in tx.CUES["sorry"])
    other = " OR ".join(f"contains({low}, '{w}')" for k in ("contact", "ask") for w in tx.CUES[k])
    thank = " OR ".join(f"contains({low}, '{w}')" for w in tx.CUES["thank"])
    e = lambda s: s.replace("'", "''")
    return rf"""draft_a AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), 'https?://\S+|t\.co/\S+', '', 'g') AS t FROM {table}),
draft_b AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\+?[0-9][0-9\s().-]{{7,}}[0-9]', '', 'g'), '\b[0-9]{{13,17}}\b', '', 'g'), '@[\p{{L}}\p{{N}}_]+', '', 'g'), '\^[A-Za-z0-9]+', '', 'g') AS t FROM draft_a),
draft_c AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^[ .,;-]+|[ .,;-]+$', '', 'g') AS t FROM draft_b),
draft_d AS (SELECT doc_id, text, t, CASE WHEN length(t) <= 220 THEN t WHEN instr(t, ' ') = 0 THEN t WHEN strpos(substr(t, 1, 221), ' ') = 0 THEN string_split(t, ' ')[1] ELSE substr(t, 1, 221 - strpos(reverse(substr(t, 1, 221)), ' ')) END AS body FROM draft_c),
draft_f AS (SELECT doc_id, CASE WHEN {sorry} THEN '{e(policy.opener("sorry", ""))}' WHEN {other} THEN '{e(policy.opener("default", ""))}' WHEN {thank} THEN '{e(policy.opener("thank", ""))}' ELSE '{e(policy.opener("default", ""))}' END AS o,
  CASE WHEN body <> t AND body <> '' AND NOT regexp_matches(body, '[.!?]$') THEN body || '.' ELSE body END AS body FROM draft_d),
drafts AS (SELECT doc_id, o || CASE WHEN body <> '' THEN ' ' || body ELSE '' END || ' {e(policy.NEXT_STEP)}' AS draft FROM draft_f)"""


@query("WITH " + draft_parts("documents") + " SELECT doc_id, draft FROM drafts")
def draft_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", policy.draft_auto(F.col("text")).alias("draft"))


@query(
    "WITH " + draft_parts("documents") + r""", w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(draft), '[a-z]{5,}'), lambda x: NOT regexp_matches(x, '^(http|tco)'))) AS a,
  list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{5,}'), lambda x: NOT regexp_matches(x, '^(http|tco)'))) AS b FROM drafts JOIN documents USING (doc_id))
SELECT doc_id, len(list_intersect(a, b)) >= 2 AS grounded FROM w"""
)
def grounded_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's draft reuses at least two of its words."""
    rows = docs(spark, sf_dir).withColumn("draft", policy.draft_auto(F.col("text")))
    return rows.select("doc_id", tx.shares_words(F.col("draft"), F.col("text")).alias("grounded"))
