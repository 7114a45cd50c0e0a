"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm import bpe, chat_formatting, edit_counts, exact_dedup, filter_audit, line_dedup, mixing, ngram_join, quality_rules, simhash, toxicity, url_filters, whitening
from colloq.session import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    shown = F.transform("removed", lambda r: F.concat_ws(":", r["line_no"].cast("string"), r["by_doc_id"].cast("string"), r["by_line_no"].cast("string")))
    return rows.select("doc_id", "n_removed", F.array_join(shown, ",").alias("removed"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents")))
    base = quality_rules.BASE.mask(quality_rules.RULES)
    failed = F.col("failures").bitwiseAND(F.lit(base).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failures")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return chat_formatting.format_preferences(chat_formatting.crossed(turns))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file's text, read on the driver (default: the public byte-level BPE with 50k ids)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.counted_edits(read(spark, sf_dir, "documents"), vocabulary_text())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary_text(), with_ids=False, keep_text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_simhash, op4_exact_dedup, op5_chat_formatting, op6_url_filters, op7_mixing, op8_toxicity, op9_token_counts, op10_bpe, op11_ngram_join, op12_filter_audit, op13_whitening)}

SQL = {
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS s
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) > 7)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
        FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM b""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op5_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, ''), coalesce(text, '')) = 1),
c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
ring AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), first_value(conv_id) OVER (ORDER BY conv_id)) AS donor FROM (SELECT DISTINCT conv_id FROM t)),
part AS (SELECT conv_id, donor, turn AS start FROM c JOIN ring USING (conv_id) WHERE place = ((conv_id % n) * 7 + 3) % n),
x AS (SELECT p.conv_id AS pair_id, t.turn, 'chosen' AS side, role, text FROM part p JOIN t ON t.conv_id = p.conv_id
        UNION ALL SELECT p.conv_id, t.turn, 'rejected', role, text FROM part p JOIN t ON (t.conv_id = p.conv_id AND t.turn < start) OR (t.conv_id = p.donor AND t.turn >= start)),
a AS (SELECT pair_id, turn, count(*) AS sides, count(DISTINCT (role, text)) AS kinds FROM x GROUP BY 1, 2),
s AS (SELECT pair_id, min(turn) FILTER (sides <> 2 OR kinds <> 1) AS split FROM a GROUP BY 1),
y AS (SELECT x.*, s.split, split IS NULL OR turn < split AS shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said FROM x JOIN s USING (pair_id)),
z AS (SELECT *, sum(CASE WHEN shared THEN 0 ELSE length(said) END) OVER (PARTITION BY pair_id, side ORDER BY turn) AS upto FROM y)
SELECT pair_id, count(*) FILTER (shared AND side = 'chosen') AS prompt_turns,
  coalesce(string_agg(said, '' ORDER BY turn) FILTER (shared AND side = 'chosen'), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY turn) FILTER (NOT shared AND side = 'chosen'), '') AS chosen,
  coalesce(string_agg(said, '' ORDER BY turn) FILTER (NOT shared AND side = 'rejected'), '') AS rejected,
  coalesce(string_agg((upto - length(text) - 8) || ':' || (upto - 1), ',' ORDER BY turn) FILTER (NOT shared AND side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((upto - length(text) - 8) || ':' || (upto - 1), ',' ORDER BY turn) FILTER (NOT shared AND side = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM z GROUP BY pair_id""",
    "op6_url_filters": r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rule, rhost, rpath) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
        ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM q JOIN rules
        ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
f AS (SELECT q.*, rule, ruled, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '') END AS form
        FROM q LEFT JOIN best USING (page_id)),
a AS (SELECT form, bool_or(ruled = 'allow') AS any_allow, bool_or(ruled = 'block') AS any_block FROM f WHERE form IS NOT NULL GROUP BY form)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN any_allow THEN 'allow' WHEN any_block THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN a USING (form)""",
    "op11_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM d),
c AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT c, n, unnest(s) AS t FROM c),
p AS (SELECT a.c AS x, b.c AS y, a.n AS nx, b.n AS ny, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.c < b.c GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * i >= 90 * (nx + ny - i)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
named AS (SELECT c, s, least(c, (SELECT min(y) FROM reach WHERE x = c)) AS component_id FROM c)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id FROM s LEFT JOIN named ON named.s = s.s""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [p.x, q.x, r.x, s.x, u.x] AS o FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
s AS (SELECT o, step, o[step] AS k, o[1 : step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
y AS (SELECT part, o, step, k, n, good, toxic, fails[k] AS own, list_bool_or(list_concat([false], list_transform(earlier, lambda j: fails[j]))) AS gone,
        len(list_filter(fails, lambda z: z)) AS n_failed FROM m, s),
z AS (SELECT part, o, step, k, coalesce(sum(n) FILTER (NOT gone AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND own), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND own), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND n_failed = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (NOT gone AND own AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND own AND toxic), 0)::BIGINT AS toxic_lost FROM y GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM z""",
}
