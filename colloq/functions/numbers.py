"""Dates, ranking arithmetic and small array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def parse_message_time(c: Column) -> Column:
    """'Wed Nov 22 09:24:30 +0000 2017' to TIMESTAMP; null if it is none. The weekday is not parsed."""
    return F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def has_message_time_shape(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$"), F.lit(False))


def advance_minutes(ts: Column, minutes: Column | int) -> Column:
    n = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), n)


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((1 + n_docs) / (1 + df)) + 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def min_max(c: Column, over: Window | None) -> Column:
    """Scaled to [0, 1] in the window; a degenerate range gives 0."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high - low <= 1e-12, F.lit(0.0)).otherwise((c - low) / (high - low))


def blend(dense: Column, sparse: Column, alpha: Column | float) -> Column:
    return alpha * dense + (1 - alpha) * sparse


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def mean_of_first(c: Column, k: int = 3) -> Column:
    """Mean of the first k elements; 0 for none."""
    head = F.slice(c, 1, k)
    return F.aggregate(head, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(head))


def log_share(c: Column) -> Column:
    """log1p(x) / log1p(max x) over the table."""
    return F.log1p(c) / F.log1p(F.max(c).over(Window.partitionBy()))


def flag_of(m: Column, key: str) -> Column:
    return F.coalesce(F.element_at(m, key), F.lit(False))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def floor_index(sorted_values: Column, share: float) -> Column:
    """sorted[int(share * (n - 1))]"""
    return F.get(sorted_values, F.floor(share * (F.size(sorted_values) - 1)).cast("int"))


def rounded_index(sorted_values: Column, share: float) -> Column:
    """sorted[round(share * (n - 1))], half to even"""
    return F.get(sorted_values, F.bround(share * (F.size(sorted_values) - 1)).cast("int"))


def equal_width_bin(c: Column, bins: int = 5) -> Column:
    """0 .. bins - 1, the last bin closed; null outside [0, 1]."""
    return F.when(c.between(0, 1), F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int"))
