"""Temperature mixing of sources.

Source token shares p are raised to an exponent and normalised: q = p^a / sum(p^a). The exponent in
[0, 1] is bisected (32 points a round, evaluated where the shares are) until the mix has the target
entropy; if the flattest such mix would repeat a source more than ``max_epochs`` times, the exponent
is raised until it does not. Each source then receives ``quota = floor(q * budget)`` tokens, drawn as
whole passes over its documents and one partial pass. A pass is a block permutation: documents are
dealt into 4096 blocks by a keyed hash, and the hash orders the blocks and the documents in them.
The partial pass takes the longest prefix of its permutation that fits what is left of the quota;
its end is found by a radix search over block sums, so no task ever holds a source's documents.

Defined cases: a null source is a source of its own; a document without words (null text included)
has no tokens and its copies follow the same rule at no cost; sources without any token get weight 0
and no copies; repeated rows, having one hash, are drawn together; rows with a null doc_id are placed
by their text; an empty table gives an empty plan; other columns never collide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloq.llm.common import fresh, sized, split_words
from colloq.session import cut

BLOCK_BITS = 12
HASH_BITS = 63


@dataclass(frozen=True)
class MixTarget:
    """``entropy``: wanted entropy as a share of that of equal weights; ``budget``: tokens to draw as a share of those there are."""

    entropy: float = 0.95
    max_epochs: float = 4.0
    budget: float = 1.0
    tolerance: float = 1e-9


def _source_key() -> list[Column]:
    return [F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key")]


def place(epoch: Column | int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Where a document stands in the permutation of a pass, in [0, 2^63); its top bits are the block."""
    stand_in = F.when(F.col(doc_id).isNull(), F.col(text))
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id), stand_in, epoch if isinstance(epoch, Column) else F.lit(epoch)), 1)


def block(at: Column) -> Column:
    return F.shiftright(at, HASH_BITS - BLOCK_BITS)


def tokens_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, its key, n_tokens (words) and the place in the partial pass."""
    return docs.select("doc_id", "source", *_source_key(), F.size(split_words(F.col("text"))).cast("long").alias("n_tokens"), place(-1).alias("at"))


def _scan(shares: DataFrame, low: float, high: float, steps: int = 32) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest number of passes for a budget of 1) at evenly spaced exponents."""
    points = F.array(*[F.lit(low + (high - low) * i / steps) for i in range(steps + 1)])
    each = shares.where("tokens > 0").select("p", F.explode(points).alias("a")).withColumn("w", F.pow("p", "a"))
    sums = each.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("p")).alias("m"))
    return sorted((r.a, math.log(r.z) - r.wl / r.z, r.m / r.z) for r in sums.collect())


def bisect_exponent(shares: DataFrame, target: MixTarget) -> float:
    """``shares`` has tokens and p; the driver sees 33 numbers a round, however many sources there are."""
    n = shares.where("tokens > 0").count()
    if n < 2:
        return 1.0

    def find(ok, low: float, high: float, rising: bool) -> float:
        # rising: ok holds from some exponent upwards, and the smallest is wanted; else the largest
        while high - low > target.tolerance:
            seen = _scan(shares, low, high)
            good = [a for a, h, m in seen if ok(h, m)]
            if not good:
                return high if rising else low
            if rising:
                at = min(good)
                if at == seen[0][0]:
                    return at
                low, high = max(a for a, _, _ in seen if a < at), at
            else:
                at = max(good)
                if at == seen[-1][0]:
                    return at
                low, high = at, min(a for a, _, _ in seen if a > at)
        return high if rising else low

    wanted = target.entropy * math.log(n)
    a = find(lambda h, m: h >= wanted - 1e-12, 0.0, 1.0, rising=False)
    if target.max_epochs:
        a = find(lambda h, m: m * target.budget <= target.max_epochs + 1e-12, a, 1.0, rising=True)
    return round(a, 9)


def _first_over(buckets: DataFrame, bucket: str) -> DataFrame:
    """Per source, the bucket in which the running sum of tokens passes ``room``, and the room left before it."""
    w = Window.partitionBy("no_source", "source_key").orderBy(bucket)
    running = buckets.withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = running.where("upto > room").groupBy("no_source", "source_key").agg(F.min(F.struct(bucket, (F.col("room") - F.col("upto") + F.col("tokens")).alias("left"))).alias("first"))
    return over.select("no_source", "source_key", f"first.{bucket}", F.col("first.left").alias("room"))


def mix_plan(tokens: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """One row per source: weight, quota, passes (whole) and ``cut_at``, the end of the partial pass.

    ``tokens`` is a materialised :func:`tokens_of`.
    """
    keys = ["no_source", "source_key"]
    shares = cut(tokens.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")))
    total = shares.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    shares = shares.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    a = bisect_exponent(shares, target)
    z = shares.where("tokens > 0").agg(F.sum(F.pow("p", F.lit(a))).alias("z")).first()["z"] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow("p", F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    plan = shares.withColumn("weight", weight).withColumn("quota", F.floor(F.col("weight") * F.lit(float(total) * target.budget)).cast("long"))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("long")
    plan = cut(plan.withColumn("passes", passes).withColumn("room", F.col("quota") - F.col("passes") * F.col("tokens")).withColumn("exponent", F.lit(a)))

    b1, b2 = block(F.col("at")), F.shiftright("at", HASH_BITS - 2 * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1).cast("long"))
    sums = tokens.groupBy(*keys, b1.alias("b1")).agg(F.sum("n_tokens").alias("tokens"))
    level1 = cut(_first_over(sums.join(plan.select(*keys, "room"), keys), "b1"))
    inside = tokens.withColumn("b1", b1).join(level1, [*keys, "b1"])
    sums = inside.groupBy(*keys, "b1", "room", b2.alias("b2")).agg(F.sum("n_tokens").alias("tokens"))
    level2 = _first_over(sums, "b2").join(level1.select(*keys, "b1"), keys)
    level2 = cut(level2.withColumn("start", F.shiftleft("b1", HASH_BITS - BLOCK_BITS) + F.shiftleft("b2", HASH_BITS - 2 * BLOCK_BITS)))
    # the last bucket holds a 2^24th of a source
    last = tokens.withColumn("b1", b1).withColumn("b2", b2).join(level2, [*keys, "b1", "b2"]).groupBy(*keys, "at", "room").agg(F.sum("n_tokens").alias("tokens"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    fits = last.withColumn("upto", F.sum("tokens").over(w)).where("upto <= room").groupBy(*keys).agg(F.max("at").alias("fit"))
    ends = level2.join(fits, keys, "left").select(*keys, F.coalesce("fit", F.col("start") - 1).alias("cut_at"))
    return cut(plan.join(ends, keys, "left").select(*keys, "tokens", "n_docs", "weight", "quota", "passes", F.coalesce("cut_at", F.lit(-1).cast("long")).alias("cut_at"), "exponent"))


def copies(passes: Column, cut_at: Column, at: Column) -> Column:
    return passes + F.when(at <= cut_at, F.lit(1)).otherwise(F.lit(0))


def mixed(docs: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight of its source, copies and its block in the partial pass."""
    tokens = cut(tokens_of(docs))
    plan = sized(mix_plan(tokens, target).drop("tokens", "n_docs"))
    joined = tokens.join(plan, ["no_source", "source_key"])
    return joined.select("doc_id", "source", "n_tokens", "weight", copies(F.col("passes"), F.col("cut_at"), F.col("at")).cast("long").alias("copies"), block(F.col("at")).alias("block"), "at")


def draw(docs: DataFrame, target: MixTarget = MixTarget(), with_order: bool = False) -> DataFrame:
    """The drawn rows, a row per copy, with the columns of ``docs`` as they were.

    ``with_order`` adds epoch, block and place: sorting by them gives each source's block permutations.
    """
    plan = mix_plan(cut(tokens_of(docs)), target)
    none, key, passes, end, epoch = fresh(docs, "none", "key", "passes", "end", "epoch")
    plan = plan.select(F.col("no_source").alias(none), F.col("source_key").alias(key), F.col("passes").alias(passes), F.col("cut_at").alias(end))
    marked = docs.withColumns({none: F.col("source").isNull(), key: F.coalesce(F.col("source").cast("string"), F.lit(""))}).join(sized(plan), [none, key])
    n = copies(F.col(passes), F.col(end), place(-1)).cast("int")
    drawn = marked.where(n > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1), n)))
    if not with_order:
        return drawn.select(*docs.columns)
    at = F.when(F.col(epoch) > F.col(passes), place(-1)).otherwise(place(F.col(epoch)))
    return drawn.select(*docs.columns, F.col(epoch).alias("epoch"), block(at).alias("block"), at.alias("place"))
