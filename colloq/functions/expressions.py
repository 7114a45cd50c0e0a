"""Building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed, lambdas included.

    A column expression that is named several times may be evaluated several times, and one named inside
    a higher-order function is evaluated for each element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
