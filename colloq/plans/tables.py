"""Joins, aggregations, samples and set guards over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloq.functions import numbers as nu
from colloq.operators import sampling as sm
from colloq.operators import stats
from colloq.plans.registry import query
from colloq.session import read
from colloq.streaming import events as ev

HASH = "({0} * 2654435761) % 1000003"


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels USING (doc_id)")
def inner_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose document is missing are an error, not a silent loss."""
    joined = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("found", F.lit(True)), "doc_id", "left")
    checked = joined.where(F.assert_true(F.col("found").isNotNull(), F.lit("a label has no document")).isNull())
    return checked.select("doc_id", "lang", "quality", "toxic")


@query("""WITH w AS (SELECT event_id, user_id, event_type, ts, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase FROM events)
SELECT event_id, user_id, purchase FROM w WHERE event_type = 'error'""")
def asof_event_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the user's latest earlier purchase: an as-of join without a join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    purchase = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts").withColumn("purchase", purchase).where("event_type = 'error'").select("event_id", "user_id", "purchase")


@query("""WITH c AS (SELECT source, lang, count(*) AS turns, sum((doc_id % 3 = 0)::INTEGER)::BIGINT AS own FROM documents GROUP BY 1, 2)
SELECT source, sum(own)::BIGINT AS support_messages, sum(turns - own)::BIGINT AS customer_messages, count(*) AS n_conversations, round(avg(turns), 6) AS avg_turns, quantile_cont(turns, 0.5)::DOUBLE AS median_turns FROM c GROUP BY 1""")
def brand_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.profile(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "lang", F.col("doc_id") % 3 == 0)
    return rows.withColumn("avg_turns", F.round("avg_turns", 6))


@query("""WITH p AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1), s AS (SELECT source, n, chars, round(0.55 * ln(1 + n) / ln(1 + max(n) OVER ()) + 0.45 * ln(1 + chars) / ln(1 + max(chars) OVER ()), 6) AS score FROM p)
SELECT source, n, chars, score, (row_number() OVER (ORDER BY score DESC, source))::INTEGER AS place FROM s""")
def brand_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return stats.scoreboard(p, "source", {"n": 0.55, "chars": 0.45})


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'All' ELSE source END AS source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)""")
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.crosstab(read(spark, sf_dir, "documents").select("lang", "source"), "lang", "source")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def value_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(read(spark, sf_dir, "documents"), "source", 10)


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(text) - count(DISTINCT text) AS n_duplicates FROM documents")
def dup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicates(read(spark, sf_dir, "documents"), "text")


@query("""WITH j AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'quality' AS column_name, count(*) FILTER (quality IS NULL) AS n_null, round(avg((quality IS NULL)::INTEGER), 6) AS null_rate FROM j UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), round(avg((toxic IS NULL)::INTEGER), 6) FROM j""")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.null_rates(j, ["quality", "toxic"]).withColumn("null_rate", F.round("null_rate", 6))


@query("SELECT date_trunc('month', ts)::TIMESTAMP AS period, count(*) AS n, sum((event_type = 'error')::INTEGER)::BIGINT AS n_flagged FROM events GROUP BY 1")
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.period_counts(read(spark, sf_dir, "events"), "ts", "month", F.col("event_type") == "error")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, sum((value > 100)::INTEGER)::BIGINT AS n_flagged FROM events GROUP BY 1")
def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.period_counts(read(spark, sf_dir, "events"), "ts", "day", F.col("value") > 100)


@query("""WITH j AS (SELECT d.lang, d.source, l.quality::VARCHAR AS quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT field, value, count(*) AS n FROM (SELECT 'lang' AS field, coalesce(lang, 'MISSING') AS value FROM j UNION ALL SELECT 'source', coalesce(source, 'MISSING') FROM j UNION ALL SELECT 'quality', coalesce(quality, 'MISSING') FROM j) GROUP BY 1, 2""")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.category_summary(j, ["lang", "source", "quality"])


@query(r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents), n AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY 1),
c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT lang, term, n, n_docs, n / n_docs AS weight, row_number() OVER (PARTITION BY lang ORDER BY n / n_docs DESC, term) AS place FROM c JOIN n USING (lang))
SELECT lang, term, n, round(weight, 6) AS weight, place::INTEGER AS place FROM r WHERE place <= 5""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0).alias("terms"))
    return stats.top_terms(d, "terms", 5, "lang").select("lang", "term", "n", F.round("weight", 6).alias("weight"), "place")


@query("""WITH j AS (SELECT doc_id, concat_ws(';', CASE WHEN quality = 0 THEN 'low' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS codes FROM labels) SELECT codes, count(*) AS n FROM j GROUP BY 1""")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array_compact(F.array(F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, "toxic")))
    return stats.label_sets(read(spark, sf_dir, "labels").select("doc_id", codes.alias("labels")), "labels")


# --- dates, numbers, JSON ---


@query("SELECT event_id, ts AS parsed, true AS well_formed, ts + INTERVAL 90 MINUTE AS later FROM events")
def message_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps written in the message format ('Mon Jan 01 …') and read again."""
    shown = F.concat(F.date_format("second", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("second", "yyyy"))
    e = read(spark, sf_dir, "events").select("event_id", "ts", F.date_trunc("second", "ts").alias("second")).withColumn("s", shown)
    parsed = nu.parse_message_time(F.col("s")) + (F.col("ts") - F.col("second"))
    return e.select("event_id", parsed.alias("parsed"), nu.has_message_time_shape(F.col("s")).alias("well_formed")).withColumn("later", nu.advance_minutes(F.col("parsed"), 90))


@query("""WITH e AS (SELECT event_id, user_id, ts, strftime(ts, '%a %b %d %H:%M:%S') AS s FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS by_time, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS by_text FROM e""")
def lexical_vs_parsed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.date_format("ts", "EEE MMM dd HH:mm:ss").alias("s"))
    place = lambda c: F.row_number().over(Window.partitionBy("user_id").orderBy(c, "event_id")).cast("long")
    return e.select("event_id", place("ts").alias("by_time"), place("s").alias("by_text"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, '{\"k\":' || (props::JSON ->> '$.k') || '}' AS again FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "struct<k:bigint>")
    return read(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", "p.k", F.to_json("p").alias("again"))


@query("SELECT event_type, round(100 * avg((event_type = 'error')::INTEGER), 2) AS pct_error, round(100 * avg((value > 100)::INTEGER), 2) AS pct_large, 0.0::DOUBLE AS pct_absent FROM events GROUP BY 1")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.create_map(F.lit("is_error"), F.col("event_type") == "error", F.lit("is_large"), F.col("value") > 100)
    e = read(spark, sf_dir, "events").select("event_type", flags.alias("m"))
    shares = {"pct_error": "is_error", "pct_large": "is_large", "pct_absent": "no_such_flag"}
    return e.groupBy("event_type").agg(*[stats.percent(nu.flag_of(F.col("m"), k)).alias(n) for n, k in shares.items()])


# --- samples, splits, guards ---


@query("WITH g AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY " + HASH.format("conv_id") + """, conv_id) AS place, count(*) OVER () AS n FROM g)
SELECT c.conv_id, c.turn, CASE WHEN place <= round_even(n * 0.7, 0) THEN 'train' WHEN place <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'validation' ELSE 'test' END AS split FROM conversations c JOIN r USING (conv_id)""")
def split_701515(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sm.split_groups(rows, "conv_id", {"train": 0.7, "validation": 0.15, "test": 0.15}, sm.portable_hash(F.col("conv_id"))).select("conv_id", "turn", "split")


@query("SELECT doc_id FROM documents ORDER BY " + HASH.format("doc_id") + ", doc_id LIMIT 100")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sample_rows(read(spark, sf_dir, "documents").select("doc_id"), 100, sm.portable_hash(F.col("doc_id")), "doc_id")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY " + HASH.format("doc_id") + """, doc_id) AS place, count(*) OVER (PARTITION BY lang) AS size, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang FROM r WHERE place <= round_even(100.0 * size / total, 0) + 1""")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.proportional_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 100, sm.portable_hash(F.col("doc_id")), "doc_id")


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY " + HASH.format("(conv_id * 100 + turn)") + ", turn) AS p, " + HASH.format("(conv_id * 100 + turn)") + " AS h FROM conversations) SELECT conv_id, turn FROM r WHERE p = 1 ORDER BY h, turn LIMIT 30")
def distinct_group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [sm.portable_hash(F.col("conv_id") * 100 + F.col("turn")), F.col("turn")]
    return sm.one_per_group(read(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", order, 30)


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (length(trim(text)) > 40) DESC, turn) AS p FROM conversations) SELECT conv_id, turn FROM r WHERE p = 1""")
def first_long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.first_long_enough(read(spark, sf_dir, "conversations"), "conv_id", "text", ["turn"], 40).select("conv_id", "turn")


@query("""WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), f AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY size DESC, lang) <= 60 THEN 1 ELSE 0 END AS one FROM s),
g AS (SELECT *, least(60, sum(size) OVER ()) - sum(one) OVER () AS rest, size - one AS free, greatest(1, sum(size - one) OVER ()) AS all_free FROM f), h AS (SELECT *, rest * free // all_free AS whole, rest * free % all_free AS remainder FROM g),
q AS (SELECT lang, one + whole + CASE WHEN remainder > 0 AND row_number() OVER (ORDER BY remainder DESC, size DESC, lang) <= rest - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM h),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 2654435761) % 1000003, doc_id) AS place FROM documents) SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE place <= quota""")
def quota_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty documents with language quotas that add up exactly."""
    order = [sm.portable_hash(F.col("doc_id")), F.col("doc_id")]
    return sm.quota_pick(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 60, order)


@query("""WITH s AS (SELECT text AS t, 'benchmark' AS set_name FROM benchmark UNION SELECT text, 'even' FROM documents WHERE doc_id % 2 = 0 UNION SELECT text, 'odd' FROM documents WHERE doc_id % 2 = 1)
SELECT md5(t) AS text_md5, count(DISTINCT set_name) AS n_sets, string_agg(DISTINCT set_name, ',' ORDER BY set_name) AS sets FROM s GROUP BY t HAVING count(DISTINCT set_name) > 1""")
def cross_split_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur in more than one of three sets."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    found = sm.in_several({"benchmark": read(spark, sf_dir, "benchmark").select(F.col("text").alias("t")), "even": d.where("doc_id % 2 = 0"), "odd": d.where("doc_id % 2 = 1")}, "t")
    return found.select(F.md5("t").alias("text_md5"), "n_sets", "sets")


@query("SELECT doc_id, count(DISTINCT s) AS n_sets, string_agg(DISTINCT s, ',' ORDER BY s) AS sets FROM (SELECT doc_id, 'low' AS s FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) GROUP BY doc_id HAVING count(DISTINCT s) > 1")
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "labels")  # noqa: E741
    return sm.in_several({"low": l.where("quality = 0"), "toxic": l.where("toxic = 1")}, "doc_id")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right_only' ELSE 'left_only' END AS side FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def coverage_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.symmetric_difference(read(spark, sf_dir, "documents").where("lang = 'en'"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def id_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").intersect(read(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE source = 'src1' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def id_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id").union(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")).distinct()


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source NOT IN ('src0', 'src1') GROUP BY source")
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.violations(read(spark, sf_dir, "documents"), {"lang": ["en", "de"], "source": ["src0", "src1"]})


@query("""SELECT 'sample' AS population, count(*) AS n, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5)::DOUBLE AS median, min(n_chars) AS least, max(n_chars) AS greatest FROM (SELECT n_chars FROM documents ORDER BY """ + HASH.format("doc_id") + """, doc_id LIMIT 100)
UNION ALL SELECT 'corpus', count(*), round(avg(n_chars), 6), quantile_cont(n_chars, 0.5)::DOUBLE, min(n_chars), max(n_chars) FROM documents""")
def representativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sm.representativeness(sm.sample_rows(d, 100, sm.portable_hash(F.col("doc_id")), "doc_id"), d, "n_chars").withColumn("mean", F.round("mean", 6))


# --- event windows (beyond the reference) ---


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.tumbling(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(read(spark, sf_dir, "events"))


@query("SELECT DISTINCT event_id FROM events")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.deduplicated(read(spark, sf_dir, "events")).select("event_id")
