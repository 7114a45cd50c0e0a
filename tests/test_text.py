"""Text and number functions on worked examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloq.functions import numbers as nu
from colloq.functions import text as tx
from colloq.functions.language import detect_language


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (tx.clean_text, " see https://t.co/x  @bob\nok ", "see URL @USER ok"),
        (tx.clean_text, None, ""),
        (tx.canonical_template, "Hi @bob, order 12,345 at https://t.co/x!", "hi @USER order # at URL"),
        (tx.tokens, "déjà vu 12 -- it's", ["déjà", "vu", "--", "it's"]),
        (tx.first_number, "1,2", 1),
        (tx.first_number, "n/a", None),
        (tx.cue, "We apologize", "sorry"),
        (tx.cue, "please share it", "ask"),
        (tx.cue, None, "default"),
        (tx.strip_code_fence, '```json\n{"a":1}\n```', '{"a":1}'),
        (tx.rubric_bucket, "I want a refund", "refund"),
        (tx.rubric_bucket, "hello", "unmatched"),
        (tx.is_low_content, "@USER ok", True),
        (tx.grounded_body, "a" * 230, "a" * 230),
        (tx.grounded_body, "", ""),
        (detect_language, "where is the order", "en"),
        (detect_language, "donde esta mi pedido", "es"),
        (detect_language, "de", "es"),
        (detect_language, "こんにちは", "ja"),
        (detect_language, "", "unknown"),
        (detect_language, None, "unknown"),
        (detect_language, "12345", "unknown"),
        (detect_language, "привет", "unknown"),
        (detect_language, "zzz", "en"),
        (detect_language, "éé", "other"),
    ],
)
def test_function(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_parse_context_loses_unprefixed_parts(spark):
    got = one(spark, "BRAND: x | y | CUSTOMER: z", tx.parse_context)
    assert [tuple(r) for r in got] == [("brand", "x"), ("customer", "z")]


def test_sanitize(spark):
    got = one(spark, "Hi @bob call 1-800-555-0199 about 1234567890123 ^RB https://x.y/z ok.", tx.sanitize)
    assert not any(x in got for x in ("@bob", "555", "1234567890123", "^RB", "http"))
    assert got.startswith("Hi") and got.endswith("ok")


def test_grounded_body_is_cut_at_a_space(spark):
    got = one(spark, "word " * 100 + "end", tx.grounded_body)
    assert len(got) <= 221 and got.endswith("word.")


def test_context_and_message(spark):
    row = spark.createDataFrame([("m", [("brand", "b"), ("customer", "")])], "m string, c array<struct<role:string,text:string>>")
    assert row.select(tx.context_and_message(F.col("m"), F.col("c"))).first()[0] == "Previous support: b\nCurrent customer: m"
    assert row.select(tx.context_and_message(F.col("m"), F.lit(None))).first()[0] == "Current customer: m"


def test_response_flags(spark):
    row = spark.createDataFrame([("Sorry! Please DM us: https://x.y/help",), (" ",), (None,)], "x string")
    got = row.select(*[c.alias(k) for k, c in tx.response_flags(F.col("x")).items()]).collect()
    assert got[0].asks_dm and got[0].contains_apology and got[0].contains_help_url and got[0].contains_instruction
    assert not any(got[1]) and not any(got[2])


def test_message_time(spark):
    assert one(spark, "Wed Nov 22 09:24:30 +0000 2017", nu.parse_message_time) == dt.datetime(2017, 11, 22, 9, 24, 30)
    assert one(spark, "nonsense", nu.parse_message_time) is None
    assert one(spark, "Wed Nov 22 09:24:30 +0000 2017", nu.has_message_time_shape)
    assert one(spark, dt.datetime(2017, 12, 31, 23, 59), lambda c: nu.advance_minutes(c, 1), "timestamp") == dt.datetime(2018, 1, 1)


def test_indices(spark):
    df = spark.createDataFrame([([float(i) for i in range(1, 31)],)], "v array<double>")
    assert df.select(nu.floor_index(F.col("v"), 0.95)).first()[0] == 28
    nine = spark.createDataFrame([([float(i) for i in range(1, 10)],)], "v array<double>")
    assert nine.select(nu.rounded_index(F.col("v"), 0.25)).first()[0] == 3
