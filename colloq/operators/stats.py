"""Aggregations: profiles, rates, contingency tables, distributions, co-occurrence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Names of a vocabulary that a join may broadcast.
BROADCAST_NAMES = 100_000


def percent(c: Column, digits: int = 2) -> Column:
    """Share of true among non-null, in per cent."""
    return F.round(100 * F.avg(c.cast("double")), digits)


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_null, null_rate), one pass."""
    row = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns], F.count("*").alias("__n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0)).alias("n_null")) for c in columns])
    return row.select("__n", F.explode(pairs).alias("p")).select("p.column_name", "p.n_null", F.when(F.col("__n") > 0, F.col("p.n_null") / F.col("__n")).alias("null_rate"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts with margins ('All'), from one cube."""
    label = lambda c: F.when(F.grouping(c) == 1, F.lit("All")).otherwise(F.col(c).cast("string"))
    return df.cube(a, b).agg(F.count("*").alias("n"), label(a).alias("__a"), label(b).alias("__b")).select(F.col("__a").alias(a), F.col("__b").alias(b), "n")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(top) if top else counts


def size_summary(df: DataFrame, group: str) -> DataFrame:
    """Mean, median, p90 and largest size of the groups."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9)))
    return sizes.agg(F.count("*").alias("n_groups"), F.avg("n").alias("mean_size"), p.alias("p"), F.max("n").alias("max_size")).select("n_groups", "mean_size", F.col("p")[0].alias("median_size"), F.col("p")[1].alias("p90_size"), "max_size")


def size_histogram(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(column).alias("n_distinct"), (F.count(column) - F.count_distinct(column)).alias("n_duplicates"))


def category_summary(df: DataFrame, fields: Sequence[str], missing: str = "MISSING") -> DataFrame:
    """(field, value, n) of several categorical fields in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit(missing)).alias("value")) for f in fields])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def cooccurrence(df: DataFrame, row_id: str, labels: str) -> DataFrame:
    """(a, b, n): rows that carry both labels, the diagonal included; pairs are formed inside a row."""
    own = F.array_distinct(F.col(labels))
    pairs = F.flatten(F.transform(own, lambda a: F.transform(own, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def label_sets(df: DataFrame, labels: str) -> DataFrame:
    return df.groupBy(F.array_join(F.array_sort(F.array_distinct(labels)), ";").alias("codes")).agg(F.count("*").alias("n"))


def profile(df: DataFrame, brand: str, conversation: str, is_brand: Column) -> DataFrame:
    """Per brand: own and customer messages, conversations, mean and median turns."""
    per_conv = df.groupBy(brand, conversation).agg(F.count("*").alias("turns"), F.sum(is_brand.cast("bigint")).alias("own"))
    return per_conv.groupBy(brand).agg(
        F.sum("own").alias("support_messages"), F.sum(F.col("turns") - F.col("own")).alias("customer_messages"), F.count("*").alias("n_conversations"),
        F.avg("turns").alias("avg_turns"), F.percentile("turns", F.lit(0.5)).alias("median_turns"),
    )


def scoreboard(df: DataFrame, key: str, weights: Mapping[str, float], digits: int = 6) -> DataFrame:
    """Weighted log-normalised score (log1p x / log1p max x) and rank; the maxima are one aggregated row."""
    tops = df.agg(*[F.max(c).alias(f"top_{c}") for c in weights])
    joined = df.join(tops.withColumn("__one", F.lit(1)), F.lit(1) == F.col("__one"))
    score = sum((F.lit(w) * F.log1p(F.col(c)) / F.log1p(F.col(f"top_{c}")) for c, w in weights.items()), F.lit(0.0))
    scored = joined.select(*df.columns, F.round(score, digits).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def period_counts(df: DataFrame, ts: str, unit: str, flag: Column) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, F.col(ts)).alias("period")).agg(F.count("*").alias("n"), F.sum(flag.cast("bigint")).alias("n_flagged"))


def top_terms(df: DataFrame, terms: str, k: int, group: str | None = None) -> DataFrame:
    """Terms by their mean weight over documents (count / documents); the k first, of each group if given."""
    keys = [group] if group else []
    n = df.groupBy(*keys).agg(F.count("*").alias("n_docs")) if group else df.agg(F.count("*").alias("n_docs"))
    counts = df.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    joined = counts.join(n, keys) if group else counts.join(n.withColumn("__one", F.lit(1)), F.lit(1) == F.col("__one")).drop("__one")
    weighted = joined.withColumn("weight", F.col("n") / F.col("n_docs"))
    if not group:
        return weighted.orderBy(F.desc("weight"), "term").limit(k)
    w = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return weighted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def code_counts(df: DataFrame, codes: str) -> DataFrame:
    """(code, n): rows that carry each of the codes in an array column."""
    return df.select(F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def vocabulary_counts(df: DataFrame, column: str, vocabulary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n) for every value of ``vocabulary(value)``, zero where none is counted."""
    counts = df.groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    names = F.broadcast(vocabulary) if vocabulary.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else vocabulary
    every = df.select(*by).distinct().crossJoin(names) if by else vocabulary  # the rows of the result, zeros included
    return every.join(counts, [*by, "value"], "left").select(*by, "value", F.coalesce("n", F.lit(0)).alias("n"))


def output_sizes(df: DataFrame, text: str) -> DataFrame:
    """Number of outputs, empty ones, and the mean length of the others."""
    length = F.length(F.coalesce(text, F.lit("")))
    return df.agg(F.count("*").alias("n"), F.count_if(length == 0).alias("n_empty"), F.avg(F.when(length > 0, length)).alias("avg_chars"))


def by_most_codes(df: DataFrame, codes: str, key: str) -> DataFrame:
    """Rows with the most codes first, then by id."""
    return df.orderBy(F.size(codes).desc(), key)


def in_named_order(df: DataFrame, column: str, names: Sequence[str], *then: str) -> DataFrame:
    """Rows in the order of ``names``, other values behind them, then by the other columns."""
    place = F.lit(len(names))
    for i, name in enumerate(names):
        place = F.when(F.col(column) == name, i).otherwise(place)
    return df.orderBy(place, *then)
