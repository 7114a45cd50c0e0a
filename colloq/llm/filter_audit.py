"""Filter interaction audit through lattice-edge aggregation.

Every document is reduced once to the bits of the filters that it fails. The subsets of filters form a lattice;
an edge (applied, next) says that ``next`` is applied after the subset ``applied``: 80 edges for five filters.
What happens to a document on an edge follows from its bits, so documents are counted by (part, bits) first, at most
32 rows a part, and these contribute to the edges. Each order of the filters is a path of five edges through the
lattice, hence the 600 steps of the 120 orders are looked up among the aggregated edges and no order is ever run.

A filter's Shapley sum needs no order either: an edge below ``s`` applied filters lies on s! (4 - s)! paths.

The filter for copies looks at the whole table: a document fails it if a document with a smaller doc_id has the same
text. Texts are compared by SHA-256 and length. Only texts that occur more than once reach the join that says
which of their documents came first, and its hot keys can be split, as the exchange serves this join alone.

Defined cases: a null text counts as empty; an empty text fails the word count alone, and as a copy; a null source is the part
''; rows of one doc_id are judged one by one, and none of them is a copy of another; a row without a doc_id
has no place in the order, so it is no copy and makes none; repeated rows of ``labels`` for one doc_id count once, with a
flag if any row has it, and rows without a doc_id are no label; very long texts are read whole; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.llm.common import let, split_words
from colloq.session import cut

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
COUNTS = ("n", "good", "toxic")
EDGE_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(name: str, fails: Column) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))


def text_failures(text: Column) -> Column:
    """The bits of the filters that look at one text alone: few words, few different words, capitals, symbols."""
    whole = F.coalesce(text, F.lit(""))
    counted = let(split_words(whole), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    return let(
        counted,
        lambda c: _bit("A", c["words"] < 200)
        .bitwiseOR(_bit("B", 100 * c["distinct"] < 50 * c["words"]))
        .bitwiseOR(_bit("C", 100 * F.regexp_count(whole, F.lit("[A-Z]")) > 2 * F.length(whole)))
        .bitwiseOR(_bit("D", whole.rlike("[#$%&*|]"))),
    )


def failure_bits(docs: DataFrame) -> DataFrame:
    """doc_id, part and ``bits``, the failures of all five filters; one row per input row."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    judged = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_failures(F.col("text")).alias("bits"), F.unhex(F.sha2(whole, 256)).alias("sha"), F.octet_length(whole).alias("n_bytes"),
    )
    rows = cut(judged)
    several = rows.where("doc_id is not null").groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    marked = rows.join(several.drop("last"), ["sha", "n_bytes"], "left")
    return marked.select("doc_id", "part", F.col("bits").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), F.lit(COPY)).otherwise(F.lit(0))).alias("bits"))


def bit_counts(bits: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents by what they fail, and how many of them are labelled good or toxic."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    totals = bits.groupBy("part", "bits").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # rows without a label are never dealt out for this join
    named = bits.where("doc_id is not null").join(flags.where("good = 1 or toxic = 1"), "doc_id")
    flagged = named.groupBy("part", "bits").agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return totals.unionByName(flagged).groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in COUNTS])


def lattice() -> list[tuple[int, int]]:
    """The edges: every subset of the filters with every filter that is not in it."""
    return [(applied, k) for applied in range(1 << len(FILTERS)) for k in range(len(FILTERS)) if not applied >> k & 1]


def edges(counts: DataFrame) -> DataFrame:
    """(part, applied, next, ...): what each edge of the lattice does to the documents of a part."""
    every = F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(k).alias("next")) for a, k in lattice()])
    spread = counts.select("part", "bits", *COUNTS, F.explode(every).alias("e")).select("part", "bits", *COUNTS, "e.applied", "e.next")
    own = F.expr("shiftleft(1, next)")
    fails = F.col("bits").bitwiseAND(own) != 0
    reached = F.col("bits").bitwiseAND(F.col("applied")) == 0
    total = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(F.lit(0)))
    return spread.groupBy("part", "applied", "next").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(F.col("bits") == own).alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
    )


def shapley(lattice_edges: DataFrame) -> DataFrame:
    """(part, next, shapley): what a filter removes, summed over all orders: each edge as often as it has paths."""
    last = len(FILTERS) - 1
    paths = F.array(*[F.lit(factorial(s) * factorial(last - s)) for s in range(last + 1)])
    return lattice_edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.get(paths, F.bit_count("applied"))).cast("long").alias("shapley"))


def paths(spark) -> DataFrame:
    """(filter_order, step, applied, next): the orders of the filters as paths of edges, 600 rows for five filters."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        steps += [(name, i + 1, sum(1 << k for k in order[:i]), k) for i, k in enumerate(order)]
    return spark.createDataFrame(steps, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps and removes, and what it costs."""
    found = cut(edges(bit_counts(failure_bits(docs), labels)))
    walked = found.join(F.broadcast(paths(docs.sparkSession)), ["applied", "next"])  # 600 rows, whatever the table
    return walked.join(shapley(found), ["part", "next"]).select("part", "filter_order", "step", *EDGE_COUNTS, "shapley")
