"""Small document tables with every awkward case, and plain re-implementations to compare with."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta " * 20_000 + "end"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORDS.findall(text or "")


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)"""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


AWKWARD = [
    (1, "One two three four five six seven."),
    (2, "ONE two three four five six seven."),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, "x"),
    (7, LONG),
    (7, LONG),
    (None, "no id"),
    (None, "no id"),
    (8, "One two three four five six seven."),
    (9, "éÉ ÀB ß 漢字 🙂 é  nbsp  em"),
    (10, "a\nb\na\n\nb\r\n c"),
]
CLASHING = ("n_words", "failures", "fp", "row", "sha", "kept", "__t", "__m", "__row", "rank", "at", "passes", "ids", "line_no", "doc", "h", "t", "k1", "n", "w", "component_id", "keep_id", "size", "run", "best")


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
