"""Evaluation: retrieval quality, classification, calibration, agreement, policies, error taxonomies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloq.functions import numbers as nu
from colloq.operators.retrieval import top_k
from colloq.session import cut

RELEVANT, USEFUL = 1, 2


def level_totals(judgements: DataFrame) -> DataFrame:
    """(query_id, level, n) of judgements(query_id, doc_id, level)."""
    return judgements.groupBy("query_id", "level").agg(F.count("*").alias("n"))


def group_judgements(hits: DataFrame, documents: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judgements of the hits, level totals) where every document of a query's group but itself is judged.

    documents(doc_id, group, level), queries(query_id, group). The pairs of a group grow with its square; of these only those that were
    found are made, and the others are counted from the sizes of groups.
    """
    pairs = hits.select("query_id", "doc_id").distinct().where("query_id <> doc_id")
    found = pairs.join(queries, "query_id").join(documents.withColumnRenamed("group", "__g"), "doc_id").where(F.col("group") == F.col("__g"))
    sizes = documents.groupBy("group", "level").agg(F.count("*").alias("n"))
    asked = queries.join(sizes, "group").select("query_id", "level", "n")
    own = queries.join(documents.withColumnRenamed("doc_id", "query_id"), ["query_id", "group"]).select("query_id", "level", F.lit(-1).cast("bigint").alias("n"))
    totals = asked.unionByName(own).groupBy("query_id", "level").agg(F.sum("n").alias("n")).where("n > 0")
    return found.select("query_id", "doc_id", "level"), totals


def retrieval_per_query(hits: DataFrame, judgements: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), at_least: int = RELEVANT, totals: DataFrame | None = None) -> DataFrame:
    """Per judged query: recall at each k, reciprocal rank, and whether anything good is in the first five.

    hits(query_id, doc_id, rank), judgements(query_id, doc_id, level). A query without relevant
    documents has recall 0, as its numerator is 0 whatever it is divided by. With ``totals`` (see :func:`group_judgements`)
    ``judgements`` need not have pairs that were not found.
    """
    good = judgements.where(F.col("level") >= at_least)
    counted = level_totals(judgements) if totals is None else totals
    totals = counted.groupBy("query_id").agg(F.sum(F.when(F.col("level") >= at_least, F.col("n")).otherwise(0)).alias("n_relevant"))
    found = hits.join(good.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.min("rank").alias("first"), *[F.sum((F.col("rank") <= k).cast("bigint")).alias(f"in_{k}") for k in ks]
    )
    joined = totals.join(found, "query_id", "left")
    floor = F.greatest(F.lit(1), F.col("n_relevant"))
    recalls = [(F.coalesce(F.col(f"in_{k}"), F.lit(0)) / floor).alias(f"recall_at_{k}") for k in ks]
    return joined.select("query_id", "n_relevant", *recalls, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("first") > 5, F.lit(True)).alias("none_in_5"))


def retrieval_summary(per_query: DataFrame, digits: int = 6) -> DataFrame:
    recalls = [c for c in per_query.columns if c.startswith("recall_at_")]
    return per_query.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), digits).alias(c) for c in recalls], F.round(F.avg("reciprocal_rank"), digits).alias("mrr"), F.round(F.avg(F.col("none_in_5").cast("double")), digits).alias("no_relevant_at_5"))


def refilled(scores: DataFrame, flag: str, k: int, digits: int | None = None) -> DataFrame:
    """The k best (query_id, doc_id, score) per query once flagged ones are dropped, so that lower ones move up."""
    return top_k(scores.where(~F.col(flag)), k, digits=digits)


def class_metrics(rows: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class (of gold or prediction): tp, support, precision, recall, F1 with 0 for empty denominators."""
    pairs = rows.groupBy(*by, gold, pred).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col(gold).alias("label"), F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    sums = pairs.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "predicted")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(*by, "label", "tp", "support", "predicted", ratio(tp, predicted).alias("precision"), ratio(tp, support).alias("recall"), ratio(2 * tp, support + predicted).alias("f1"))


def classification_summary(rows: DataFrame, gold: str, pred: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Accuracy, macro P/R/F1 and weighted F1."""
    per = class_metrics(rows, gold, pred, by)
    n = F.sum("support")
    return per.groupBy(*by).agg(
        n.alias("n"), F.round(F.sum("tp") / n, digits).alias("accuracy"), F.round(F.avg("f1"), digits).alias("macro_f1"), F.round(F.avg("precision"), digits).alias("macro_precision"),
        F.round(F.avg("recall"), digits).alias("macro_recall"), F.round(F.sum(F.col("f1") * F.col("support")) / n, digits).alias("weighted_f1"),
    )


def on_shared_labels(rows: DataFrame, gold: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose gold label is in ``vocabulary(label)``."""
    return rows.join(vocabulary.select(F.col("label").alias(gold)).distinct(), gold, "left_semi")


def learning_curve(rows: DataFrame, size: str, gold: str, pred: str, vocabulary: DataFrame, digits: int = 6) -> DataFrame:
    """Per training size the scores on all rows and on those whose label every model knows."""
    whole = classification_summary(rows, gold, pred, [size], digits).select(size, F.lit("all").alias("subset"), "n", "accuracy", "macro_f1", "weighted_f1")
    shared = classification_summary(on_shared_labels(rows, gold, vocabulary), gold, pred, [size], digits)
    return whole.unionByName(shared.select(size, F.lit("shared").alias("subset"), "n", "accuracy", "macro_f1", "weighted_f1"))


def misclassified(rows: DataFrame, gold: str, pred: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows whose prediction is not the gold label, by id; ``limit`` of them if asked for."""
    wrong = rows.where(~F.col(gold).eqNullSafe(F.col(pred))).orderBy(key)
    return wrong.limit(limit) if limit is not None else wrong


def sliced(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows equal to all of the wanted values, such as subset, model and input."""
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def confusion(rows: DataFrame, gold: str, pred: str, labels: Sequence) -> DataFrame:
    """Label by label, in a fixed order of columns, with zeros."""
    return rows.groupBy(gold).pivot(pred, list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def top_confusions(rows: DataFrame, gold: str, pred: str, k: int = 15) -> DataFrame:
    wrong = rows.where(~F.col(gold).eqNullSafe(F.col(pred))).groupBy(gold, pred).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), gold, pred).limit(k)


def binary_confusion(rows: DataFrame, expected: Column, predicted: Column, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """2x2 counts with accuracy, precision, recall, F1 (0 for empty denominators)."""
    counted = rows.groupBy(*by).agg(
        F.count_if(expected & predicted).alias("tp"), F.count_if(~expected & predicted).alias("fp"), F.count_if(expected & ~predicted).alias("fn"), F.count_if(~expected & ~predicted).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), digits)
    return counted.select(*by, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def policies(rows: DataFrame, expected: Column, decisions: Mapping[str, Column]) -> DataFrame:
    """The 2x2 table of several decision rules, in one pass."""
    rules = F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("predicted")) for k, v in decisions.items()])
    each = rows.select(expected.alias("expected"), F.explode(rules).alias("p")).select("expected", "p.policy", "p.predicted")
    return binary_confusion(each, F.col("expected"), F.col("predicted"), ["policy"])


def expected_calibration_error(rows: DataFrame, confidence: Column, correct: Column, bins: int = 5) -> DataFrame:
    """Equal-width bins, the last closed; weights are shares of all rows with a confidence in [0, 1]."""
    binned = rows.select(nu.equal_width_bin(confidence, bins).alias("bin"), confidence.alias("c"), correct.cast("double").alias("y")).where("bin is not null")
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("mc"), F.avg("y").alias("my"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("mc") - F.col("my"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def calibration_table(rows: DataFrame, confidence: Column, correct: Column, buckets: int = 5) -> DataFrame:
    """Buckets between exact quantiles, left closed, the last closed on both sides."""
    base = rows.select(confidence.alias("c"), correct.cast("double").alias("y")).where("c is not null")
    edges = quantiles(base, "c", {f"e{i}": i / buckets for i in range(buckets + 1)}).first()  # buckets + 1 numbers
    if edges is None or edges[0] is None:
        return base.select(F.lit(0).alias("bucket"), F.count("*").over(Window.partitionBy()).alias("n"), "c", "y").where("false")
    bucket = F.lit(buckets - 1)
    for i in range(buckets - 2, -1, -1):
        bucket = F.when(F.col("c") < F.lit(edges[i + 1]), F.lit(i)).otherwise(bucket)
    return base.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("c").alias("mean_confidence"), F.avg("y").alias("accuracy"))


def kappa(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Cohen's kappa of two boolean raters; null for no rows or expected agreement 1."""
    both = rows.select(a.cast("double").alias("a"), b.cast("double").alias("b")).where("a is not null and b is not null")
    one = both.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return one.select("n", F.col("po").alias("agreement"), F.when((F.col("n") > 0) & (F.abs(1 - pe) > 1e-12), (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def agreement_summary(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rates of boolean verdicts, nulls left out."""
    return rows.agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags])


def rater_summary(rows: DataFrame, first: str, again: str, other: str) -> DataFrame:
    """Rates of a rater's verdicts, of the same rater asked again and of another; how often the rater agrees with either,
    and the gap between the two rates. Nulls are left out of each rate and agreement."""
    agree = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double"))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return rows.agg(F.count("*").alias("n"), rate(first).alias("rate"), rate(again).alias("rate_again"), rate(other).alias("rate_other"), agree(first, again).alias("self_agreement"), agree(first, other).alias("agreement")).withColumn("gap", F.col("rate") - F.col("rate_other"))


def latency(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and interpolated 95th percentile of timings."""
    found = quantiles(rows, value, {"p95": 0.95}, by)
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("avg"))
    if not by:
        return means.crossJoin(F.broadcast(found))  # one row each
    same = [means[c].eqNullSafe(found[c]) for c in by]
    return means.join(found, same, "left").select(*[means[c] for c in by], "n", "avg", "p95")


def running_counts(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, upto, total): the different values with the number of rows up to each, and of all.

    The values are ranked in ranges: a running count is that of earlier ranges and of smaller values of the own range, so no task
    sees all values of a group, however many and however large the group. Rows without a value are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = cut(counts.repartitionByRange(*by, value).withColumn("__range", F.spark_partition_id()))
    sizes = placed.groupBy(*by, "__range").agg(F.sum("n").alias("__n"))  # a row a range and group
    earlier = Window.partitionBy(*by).orderBy("__range")
    before = cut(sizes.select(*by, "__range", (F.sum("__n").over(earlier) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("total")))
    within = F.sum("n").over(Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    side = before.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), "__before", "total")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__range") == F.col("__r")]
    if before.limit(100_001).count() <= 100_000:
        side = F.broadcast(side)
    joined = placed.withColumn("__within", within).join(side, same)
    return joined.select(*by, value, (F.col("__within") + F.col("__before")).alias("upto"), "total")


def quantiles(rows: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per group, a column for each name of ``shares``; a group without values has no row."""
    running = running_counts(rows, value, by)
    last = F.col("total") - 1
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(value).cast("double")))
    found = running.groupBy(*by).agg(
        *[at(F.floor(F.lit(s) * last)).alias(f"__low_{k}") for k, s in shares.items()], *[at(F.ceil(F.lit(s) * last)).alias(f"__high_{k}") for k, s in shares.items()], F.max("total").alias("__total")
    )
    place = {k: F.lit(s) * (F.col("__total") - 1) for k, s in shares.items()}
    part = {k: p - F.floor(p) for k, p in place.items()}
    # between two equal values a quantile is that very value: their weighted mean may round to its neighbour, which splits equal rows
    between = {k: F.col(f"__low_{k}") + (F.col(f"__high_{k}") - F.col(f"__low_{k}")) * part[k] for k in shares}
    return found.select(*by, *[c.alias(k) for k, c in between.items()])


def order_statistics(rows: DataFrame, value: str, share: float) -> DataFrame:
    """Floor-index, half-even-index and interpolated quantile of one column, all from running counts."""
    running = running_counts(rows, value)
    last = F.col("total") - 1
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))
    place = F.lit(share) * last
    found = running.agg(at(F.floor(place)).alias("floor_index"), at(F.bround(place)).alias("rounded_index"), at(F.ceil(place)).alias("__high"), F.max("total").alias("total"))
    part = place - F.floor(place)
    return found.select("floor_index", "rounded_index", (F.col("floor_index") + (F.col("__high") - F.col("floor_index")) * part).alias("interpolated"))


def retrieval_failures(hits: DataFrame, judgements: DataFrame, queries: DataFrame, k: int = 5, headline: str = "dense", totals: DataFrame | None = None) -> DataFrame:
    """Per (model, query) with a useful document missing from the first k: what was missed, how, and why.

    hits(model, query_id, doc_id, rank), judgements(query_id, doc_id, level), queries(query_id, language); ``totals`` as in
    :func:`retrieval_per_query`. Queries without any useful document appear once, as model '(pool)'.
    """
    counted = level_totals(judgements) if totals is None else totals
    names = [r["model"] for r in hits.select("model").distinct().collect()]  # one name a retriever
    of = lambda level, name: F.sum(F.when(F.col("level") == level, F.col("n")).otherwise(0)).alias(name)
    judged = counted.where("level >= 1").groupBy("query_id").agg(of(2, "useful_total"), of(1, "related_total"))
    each = judged.withColumn("model", F.explode(F.array(*[F.lit(m) for m in names])))
    top = hits.where(F.col("rank") <= k).select("model", "query_id", "doc_id").join(judgements, ["query_id", "doc_id"])
    seen = top.groupBy("model", "query_id").agg(F.count_if(F.col("level") == 2).alias("useful_retrieved"), F.count_if(F.col("level") == 1).alias("related_retrieved"))
    missed = each.join(seen, ["model", "query_id"], "left").fillna(0, ["useful_retrieved", "related_retrieved"]).withColumn("related_missed", F.col("related_total") - F.col("related_retrieved"))
    missed = missed.where("useful_total > useful_retrieved").join(queries.select("query_id", "language"), "query_id")
    mode = F.when(F.col("model") == headline, "semantic_near_miss").when(F.col("language") != "en", "multilingual_crossover").otherwise("lexical_mismatch")
    rows = missed.select("model", "query_id", mode.alias("mode"), F.when(F.col("useful_retrieved") == 0, "full_useful_miss").otherwise("partial_useful_miss").alias("miss_kind"), "useful_retrieved", "useful_total", "related_missed")
    useful = counted.where("level = 2").select("query_id").distinct()
    absent = queries.join(useful, "query_id", "left_anti").join(counted.where("level = 1").select("query_id", F.col("n").alias("related_missed")), "query_id", "left")
    none = absent.select(F.lit("(pool)").alias("model"), "query_id", F.lit("benchmark_absence").alias("mode"), F.lit("no_useful_candidate_in_pool").alias("miss_kind"), F.lit(0).cast("bigint").alias("useful_retrieved"), F.lit(0).cast("bigint").alias("useful_total"), F.coalesce("related_missed", F.lit(0)).alias("related_missed"))
    return rows.unionByName(none)
