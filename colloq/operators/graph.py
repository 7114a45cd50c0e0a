"""Graph operators: reply edges, chains and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloq.session import drop_table, write_table


def connected_components(edges: DataFrame, seed: int = 17) -> DataFrame:
    """(node, component) for every node of ``edges(src BIGINT, dst BIGINT)``; component = smallest node.

    Randomised contraction: each round orders the nodes by a fresh hash, every node moves to the
    first node of its closed neighbourhood, and the edges are contracted. The expected number of
    nodes falls by a constant factor a round whatever the shape (stars, chains, cliques), so the
    rounds are logarithmic. The only shuffles are of edges and of one row per live node, hubs are
    reduced by partial aggregation, and the driver sees nothing but a count.

    Self-loops keep their node, repeated edges are harmless, null ends are ignored.

    Rounds are written as tables: a checkpoint keeps the size that the optimizer has estimated for its plan, and joined with itself round
    by round that estimate gets so many digits that planning takes minutes.
    """
    ends = edges.select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b")).where("a is not null and b is not null")
    known = write_table(ends.distinct())
    loops = known.where("a = b").select(F.col("a").alias("node")).distinct()
    live = write_table(known.where("a <> b"))
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        salt = F.lit(seed + len(rounds))
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("node"))).alias("first"))
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("node"))
        moved = write_table(near.select("a", F.least(F.col("first"), own)["node"].alias("to")))
        rounds.append(moved)
        left = live.join(moved.withColumnRenamed("to", "ta"), "a")
        right = left.join(moved.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        pair = right.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        last, live = live, write_table(pair.distinct())
        drop_table(last)
    if not rounds:
        return loops.select("node", F.col("node").alias("component"))
    label = rounds[0].select(F.col("a").alias("node"), F.col("to").alias("at"))
    for moved in rounds[1:]:
        step = label.join(moved.withColumnRenamed("a", "at"), "at", "left")
        label = step.select("node", F.coalesce("to", "at").alias("at"))
    label = write_table(label)
    for moved in rounds:
        drop_table(moved)
    least = label.groupBy("at").agg(F.min("node").alias("component"))
    linked = label.join(least, "at").select("node", "component")
    alone = loops.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(alone)


def reply_edges(messages: DataFrame, node: str, parent: str, existing_only: bool = True) -> DataFrame:
    """(src, dst): child to parent. With ``existing_only`` replies to absent messages are no edges."""
    edges = messages.select(F.col(node).cast("bigint").alias("src"), F.col(parent).cast("bigint").alias("dst")).where("src is not null and dst is not null")
    if not existing_only:
        return edges
    known = messages.select(F.col(node).cast("bigint").alias("dst")).distinct()
    return edges.join(known, "dst", "left_semi").select("src", "dst")


def conversations(messages: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, component) of every message: connected components of the reply graph, a lone message is its own."""
    parts = connected_components(reply_edges(messages, node, parent))
    nodes = messages.select(F.col(node).cast("bigint").alias("node")).where("node is not null").distinct()
    return nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def chain_roots(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, root, depth, cyclic) for every child of ``edges(src, dst)`` by pointer doubling; of several parents the smallest counts.

    Each round doubles how far every open node looks, and nodes that have reached a root are done and leave the rounds, so a chain of
    n links takes log n of them, whatever n. As long as an open node has a root, the open node next to it on its way gets done in the
    next round; so when a round gets none done, all that are open are on or before a cycle: their root and depth are null and
    ``cyclic`` is true. ``max_depth`` clips the depth that is shown, nothing else.
    """
    up = edges.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst"))
    start = write_table(up.select(F.col("src").alias("node"), F.col("dst").alias("top"), F.lit(1).cast("bigint").alias("depth")))
    children = start.select(F.col("node").alias("top"), F.lit(True).alias("open"))

    def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows whose top is a root, as it is no child, and the open ones."""
        table = write_table(rows.join(children, "top", "left"))
        reached = table.where("open is null").select("node", F.col("top").alias("root"), "depth", F.lit(False).alias("cyclic"))
        return reached, table.where("open").select("node", "top", "depth")

    done, at = placed(start)
    reached = done
    while not reached.isEmpty() and not at.isEmpty():
        # the next jump of an open node is that of its top, which is open or done
        jumps = at.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more")).unionByName(done.select(F.col("node").alias("top"), F.col("root").alias("next"), F.col("depth").alias("more")))
        reached, at = placed(at.join(jumps, "top").select("node", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth")))
        done = done.unionByName(reached)
    none = F.lit(None).cast("bigint")
    found = done.unionByName(at.select("node", none.alias("root"), none.alias("depth"), F.lit(True).alias("cyclic")))
    return found if max_depth is None else found.withColumn("depth", F.least("depth", F.lit(max_depth).cast("bigint")))
