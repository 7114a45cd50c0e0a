"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition reduces its rows to a run of digests sorted by key. Runs are then exchanged in
rounds: in each round ``2**steps`` neighbouring run groups (``steps`` levels of the binomial tree)
meet and are merged; every level keeps per digest the identifier to retain and the number of copies.
An exchange deals out (run group, digest), so a level is merged by many tasks and a group of copies,
however large, reaches the next level as one row per run group. Runs travel sorted: each block that a task
reads is in the order of the keys. Spark's exchange does not merge blocks, so the merge is the
sort above it, whose algorithm (TimSort) finds the sorted runs of its input and merges them.

Digests are verified: the key is SHA-256 together with the byte length and an independent 64-bit
hash, so texts that differ in any of them never meet.

Defined cases: a null text counts as empty; among rows with the same largest (or smallest) doc_id
and equal texts, exactly one stays; a null doc_id loses to any other; an empty table gives an empty
result; very long texts are hashed whole; other columns, of any type, are kept by :func:`drop_copies` and never collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.llm.common import ascii_lower, fresh, sized
from colloq.session import cut

KEY = ("sha", "n_bytes", "check")


def _digest(text: Column) -> list[Column]:
    return [F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check")]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, a row number that is unique in the table, and the verified digest of the normalised text."""
    rows = docs.select("doc_id", ascii_lower(F.col("text")).alias("t"), F.monotonically_increasing_id().alias("row"))
    return rows.select("doc_id", "row", *_digest(F.col("t")))


def tree_merge(rows: DataFrame, keep: str = "max", steps: int = 4) -> DataFrame:
    """One row per digest: ``best`` (doc_id and row of the row to keep) and ``size``.

    ``keep`` is "max" or "min". ``rows`` are materialised digests, so their partitions are the runs.
    """
    n_runs = max(1, rows.rdd.getNumPartitions())
    order = F.col("doc_id") if keep == "max" else -F.col("doc_id")
    level = rows.select(F.spark_partition_id().alias("run"), *KEY, F.struct(order.alias("rank"), (-F.col("row")).alias("tie"), "doc_id", "row").alias("best"), F.lit(1).cast("long").alias("size"))
    while True:
        n_runs = -(-n_runs // 2**steps)
        group = F.shiftright("run", steps).alias("run")
        # max of a struct is merged by sorting: each task reads its incoming runs as one sorted stream
        level = level.groupBy(group, *KEY).agg(F.max("best").alias("best"), F.sum("size").alias("size"))
        if n_runs == 1:
            return level.select(*KEY, "best.doc_id", "best.row", "size")


def groups(docs: DataFrame, keep: str = "max", steps: int = 4) -> DataFrame:
    """One row per input row: doc_id, row, keep_id, group_size, kept, text_sha256."""
    rows = cut(digests(docs))
    best = tree_merge(rows, keep, steps).select(*KEY, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"))
    # both sides are dealt by the digest for this join alone, so adaptive execution can split a hot group
    joined = rows.join(best, list(KEY))
    return joined.select("doc_id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "max", steps: int = 4) -> DataFrame:
    """The retained rows with their columns as they were, found again by doc_id and digest.

    Rows that share both with the retained row (repeated rows) are reduced to the one whose JSON sorts first,
    in a branch that exists only if there are any.
    """
    null, ident, sha, all_columns = fresh(docs, "null", "id", "sha", "row")
    key = [null, ident, sha]

    def keyed(df: DataFrame, digest: Column) -> DataFrame:
        return df.withColumns({null: F.col("doc_id").isNull(), ident: F.coalesce(F.col("doc_id"), F.lit(0)), sha: digest})

    rows = keyed(groups(docs, keep, steps).where(~F.col("kept")), F.unhex("text_sha256"))
    gone = cut(rows.select(*key, F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")))
    marked = keyed(docs, F.unhex(F.sha2(ascii_lower(F.col("text")), 256)))
    again = gone.where("again").select(*key).distinct()
    kept = marked.join(sized(gone.select(*key)), key, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    columns = F.struct(*[marked[c] for c in docs.columns])
    # as text, since columns without an order may be among them
    one = marked.join(again, key, "left_semi").groupBy(*key).agg(F.min_by(columns, F.to_json(columns)).alias(all_columns))
    return kept.unionByName(one.select(f"{all_columns}.*"))
