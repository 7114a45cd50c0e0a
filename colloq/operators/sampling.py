"""Splits, samples and set guards. All orders come from a hash of the id, so they repeat on any cluster."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloq.operators.metrics import quantiles
from colloq.session import cut


def portable_hash(c: Column, multiplier: int = 2654435761, modulus: int = 1000003) -> Column:
    """(id * multiplier) mod modulus: an order that other SQL engines can repeat."""
    return F.pmod(c * F.lit(multiplier), F.lit(modulus))


def ranked_rows(rows: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """``rows`` with their place (from 1) in a total order, without one task that sorts them all.

    Rows are dealt into ranges of the order; a place is that within the range behind the rows of earlier ranges.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # one row a range
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return placed.withColumn(rank, within).join(F.broadcast(before), "__range").withColumn(rank, F.col(rank) + F.col("__before")).drop("__range", "__before")


def split_groups(rows: DataFrame, group: str, shares: Mapping[str, float], order: Column) -> DataFrame:
    """``split`` per row such that no group is in two: groups in ``order``, cut at rounded (half-even) shares; the last split takes the rest."""
    groups = ranked_rows(rows.select(group).where(F.col(group).isNotNull()).distinct(), [order, F.col(group)], "__place")
    n = groups.count()
    upto, split = 0, F.lit(list(shares)[-1])
    bounds = []
    for name, share in list(shares.items())[:-1]:
        upto += round(n * share)
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        split = F.when(F.col("__place") <= bound, F.lit(name)).otherwise(split)
    return rows.join(groups.select(group, split.alias("split")), group)


def sample_rows(rows: DataFrame, n: int, order: Column, key: str) -> DataFrame:
    """Exactly n rows (or all) in a hashed order."""
    return rows.orderBy(order, key).limit(n)


def proportional_sample(rows: DataFrame, bucket: str, n: int, order: Column, key: str) -> DataFrame:
    """round(n * share of the bucket) + 1 rows of each bucket."""
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("__size"))
    total = rows.count()
    w = Window.partitionBy(bucket).orderBy(order, key)
    ranked = rows.withColumn("__place", F.row_number().over(w)).join(sizes, bucket)
    quota = F.bround(F.lit(n) * F.col("__size") / F.lit(max(1, total))) + 1
    return ranked.where(F.col("__place") <= quota).drop("__place", "__size")


def one_per_group(rows: DataFrame, group: str, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """The first row of each group; of those, the n first."""
    w = Window.partitionBy(group).orderBy(*order)
    first = rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")
    return first.orderBy(*order).limit(n) if n is not None else first


def first_long_enough(rows: DataFrame, group: str, text: str, order: Sequence[str], longer_than: int = 2) -> DataFrame:
    """Per group the first row whose trimmed text is longer than ``longer_than``, else the first row."""
    fits = F.length(F.trim(F.coalesce(text, F.lit("")))) > longer_than
    return one_per_group(rows, group, [fits.desc(), *[F.col(c) for c in order]])


def quotas(rows: DataFrame, stratum: str, want: int) -> DataFrame:
    """(stratum, size, quota): quotas that add up to ``want``, or to all rows if there are fewer.

    The ``want`` largest strata get one row each (ties: the smaller name); what is left of ``want`` is apportioned to the
    sizes less these rows by largest remainders (ties: the larger stratum, then the smaller name). Integers throughout.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    # windows over the strata, one row each
    largest = Window.orderBy(F.desc("size"), F.col(stratum).asc_nulls_last())
    first = sizes.withColumn("one", F.when(F.row_number().over(largest) <= want, 1).otherwise(0).cast("bigint"))
    every = Window.partitionBy()
    shared = first.withColumns({"left": F.greatest(F.lit(0), F.least(F.lit(want), F.sum("size").over(every)) - F.sum("one").over(every)), "open": F.col("size") - F.col("one")})
    shared = shared.withColumn("all_open", F.greatest(F.lit(1), F.sum("open").over(every)))
    parts = shared.withColumns({"whole": F.expr("left * open div all_open"), "over": F.expr("left * open % all_open")})
    missing = F.col("left") - F.sum("whole").over(every)
    by_remainder = Window.orderBy(F.desc("over"), F.desc("size"), F.col(stratum).asc_nulls_last())
    extra = F.when((F.row_number().over(by_remainder) <= missing) & (F.col("over") > 0), 1).otherwise(0)
    return parts.select(stratum, "size", (F.col("one") + F.col("whole") + extra).alias("quota"))


def quota_pick(rows: DataFrame, stratum: str, want: int, order: Sequence[Column]) -> DataFrame:
    """Stratified pick of exactly ``want`` rows (or all): of each stratum the first of ``order``, as many as its quota."""
    limits = quotas(rows, stratum, want).select(F.col(stratum).alias("__stratum"), "quota")
    ranked = rows.withColumn("__place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    picked = ranked.join(limits, F.col(stratum).eqNullSafe(F.col("__stratum"))).where(F.col("__place") <= F.col("quota"))
    return picked.drop("__place", "__stratum", "quota")


def in_several(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(key, n_sets, sets): values that occur in more than one of the named tables."""
    rows = None
    for name, df in sets.items():
        part = df.select(F.col(key), F.lit(name).alias("set_name")).where(F.col(key).isNotNull())
        rows = part if rows is None else rows.unionByName(part)
    found = rows.groupBy(key).agg(F.array_sort(F.collect_set("set_name")).alias("sets"))
    return found.where(F.size("sets") > 1).select(key, F.size("sets").cast("bigint").alias("n_sets"), F.array_join("sets", ",").alias("sets"))


def pairwise_overlaps(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(a, b, n): how many different keys each two of the named tables share, zero included; names in the given order."""
    place = {name: i for i, name in enumerate(sets)}
    pairs = [(a, b) for a in place for b in place if place[a] < place[b]]
    found = in_several(sets, key).select(F.split("sets", ",").alias("sets"))
    each = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]), lambda p: F.array_contains("sets", p["a"]) & F.array_contains("sets", p["b"]))
    counts = found.select(F.explode(each).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    every = found.sparkSession.createDataFrame(pairs, "a string, b string")
    return every.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


class OverlapError(ValueError):
    """Two sets that must be disjoint are not."""


def assert_disjoint(sets: Mapping[str, DataFrame], key: str) -> None:
    bad = in_several(sets, key).limit(5).collect()
    if bad:
        raise OverlapError(f"{key} in several sets: " + "; ".join(f"{r[key]} in {r['sets']}" for r in bad))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of only one table."""
    left, right = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, key, "full").where("__a is null or __b is null")
    return both.select(key, F.when(F.col("__a").isNull(), "right_only").otherwise("left_only").alias("side"))


def assert_subset(part: DataFrame, whole: DataFrame, key: str) -> None:
    missing = part.select(key).distinct().join(whole.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise OverlapError(f"{key} missing: " + ", ".join(str(r[key]) for r in missing))


def violations(rows: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """(field, value, n): values outside the enumerated domains, nulls included."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), (~F.coalesce(F.col(f).isin(*v), F.lit(False))).alias("bad")) for f, v in domains.items()])
    return rows.select(F.explode(pairs).alias("p")).where("p.bad").groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def representativeness(sample: DataFrame, whole: DataFrame, value: str) -> DataFrame:
    """Mean, median, least and greatest of a sample beside those of the corpus."""

    def stat(df: DataFrame, name: str) -> DataFrame:
        plain = df.agg(F.lit(name).alias("population"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
        return plain.crossJoin(F.broadcast(quantiles(df, value, {"median": 0.5}))).select("population", "n", "mean", "median", "least", "greatest")  # one row each

    return stat(sample, "sample").unionByName(stat(whole, "corpus"))
