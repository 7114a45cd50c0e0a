"""Expression helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's white space, [\x20\x09-\x0D], without the space itself.
OTHER_SPACE = "\t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows that a join may broadcast: under 10 MB for keys and a few numbers.
BROADCAST_ROWS = 100_000
LOWER = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed, lambdas included.

    A plain column expression named inside a higher-order function is evaluated again for each
    element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """Runs of [^\\x20\\x09-\\x0D]; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), OTHER_SPACE, " " * len(OTHER_SPACE))
    return F.array_remove(F.split(spaced, " "), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate in taken:
            candidate += "_"
        taken.add(candidate)
        out.append(candidate)
    return out


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table of a few short columns, marked for broadcast if it has at most ``rows`` rows.

    A larger one is left to a shuffle join, whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
