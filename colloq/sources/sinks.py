"""Sinks. Corpora stay distributed; only small reports are collected."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloq.operators import conversations

REPORT_ROWS = 10_000


def slim_corpus(cases: DataFrame, path: str) -> None:
    conversations.slim(cases).write.mode("overwrite").parquet(path)


def jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines; ``order`` sorts by the integer value of a column across the files."""
    rows = df.orderBy(F.col(order).cast("bigint"), order) if order else df
    rows.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; lists are joined by semicolons."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def _small(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    return rows


def json_report(tables: dict[str, DataFrame], path: str) -> None:
    made = {name: [r.asDict(recursive=True) for r in _small(df)] for name, df in tables.items()}
    Path(path).write_text(json.dumps(made, indent=2, sort_keys=True, default=str))


def markdown_table(df: DataFrame) -> str:
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in _small(df))])
