"""Quantiles between equal values are those values."""

from pyspark.sql import functions as F

from colloq.operators import metrics

#: 7 rows; the first edge lies at place 1.2, and 0.8 * v + 0.2 * v is not v for this value.
VALUE = next(v for v in (x / 500 for x in range(1, 500)) if v * (1 - (0.2 * 6 - 1)) + v * (0.2 * 6 - 1) > v)


def test_edges_do_not_split_equal_rows(spark):
    values = [VALUE] * 4 + [VALUE + 1, VALUE + 2, VALUE + 3]
    rows = spark.createDataFrame([(v, True) for v in values], "c double, y boolean")
    assert metrics.quantiles(rows, "c", {"q": 0.2}).first().q == VALUE
    assert {r.bucket: r.n for r in metrics.calibration_table(rows, F.col("c"), F.col("y")).collect()}[2] == 4
