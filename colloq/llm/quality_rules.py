"""Rule bitmask ledger.

Each rule is evaluated once per document. The ledger stores the measurements and one failure bit
per rule; policies are versioned bit masks over the ledger, and ablations are bitwise aggregations
over the (few) distinct failure masks, so trying another policy never reads a text again.

Defined cases: a null or blank text has zero words and fails ``few_words`` and ``base``; rows are
judged one by one, so repeated rows and null doc_ids are judged like any other; an empty table
gives an empty ledger; other columns of the input are kept and never collide with the ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.llm.common import fresh, let, split_words

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more in the document.

    Windows are compared by a 64-bit hash within one document. Only a document that has equal
    hashes sorts them; positions of repeated windows are then swept once, so the work stays
    n log n for the longest text.
    """

    def swept(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(tagged, lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["i"])), covered))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(swept(h)))

    return let(words, lambda w: F.when(F.size(w) > width, windows(w)).otherwise(F.lit(0)))


def measured(text: Column) -> Column:
    """A struct of all measurements of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = F.struct(split_words(whole).alias("w"), lines.alias("l"))
    return let(
        both,
        lambda b: F.struct(
            F.size(b["w"]).cast("long").alias("n_words"),
            F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(b["l"]) - F.size(F.array_distinct(b["l"]))).cast("long").alias("n_dup_lines"),
            repeated_words(b["w"]).cast("long").alias("n_repeat_words"),
            F.size(b["l"]).cast("long").alias("n_lines"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """``fails`` sees the measurement struct; ``bit`` never changes once a rule has been published."""

    name: str
    bit: int
    fails: Callable[[Column], Column]


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules: a document is rejected if it fails any of them."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[name] for name in self.rules)


RULES = (
    Rule("few_words", 0, lambda m: m["n_words"] < 20),
    Rule("repeated_windows", 1, lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", 2, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", 3, lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("short_words", 4, lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", 5, lambda m: m["word_chars"] > 20 * m["n_words"]),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy("v1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words")))


def failures(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits of a measurement struct (a lambda variable: each rule reads it again)."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``failures``; one row per input row."""
    entry = let(measured(F.col("text")), lambda m: F.struct(*[m[c].alias(c) for c in MEASURES], failures(m, rules).alias("failures")))
    return docs.select("doc_id", entry.alias("entry")).select("doc_id", "entry.*")


def apply_policy(ledger_rows: DataFrame, policy: Policy = POLICIES[-1], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept`` by the policy's mask; reads no text."""
    return ledger_rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0)


def ablations(ledger_rows: DataFrame, policy: Policy = POLICIES[-1], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects.

    The ledger is first reduced to its distinct masks (at most 2^rules rows).
    """
    mask = policy.mask(rules)
    masks = ledger_rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policy.rules])
    each = masks.select("bits", "n", F.explode(named).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("n_only"),
    )


def keep_by_policy(docs: DataFrame, policy: Policy = POLICIES[-1], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they were."""
    (bits,) = fresh(docs, "failures")
    judged = docs.withColumn(bits, let(measured(F.col("text")), lambda m: failures(m, rules)))
    return judged.where(F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0).drop(bits)
