"""Typed readers."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions.numbers import has_message_time_shape
from colloq.sources import schemas


class MissingSourceError(FileNotFoundError):
    """An input is not where it should be."""


def _guard(path: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingSourceError(f"no data at {path}") from error
        raise


def csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; only ``columns`` are parsed if given."""
    df = _guard(path, lambda: spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path))
    return df.select(*columns) if columns else df


def messages(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return csv(spark, path, schemas.MESSAGES, columns)


def build_cache(spark: SparkSession, source: str, target: str) -> DataFrame:
    """The whole table as Parquet (never a projection, which would poison later reads)."""
    messages(spark, source).write.mode("overwrite").parquet(target)
    return parquet(spark, target)


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = _guard(path, lambda: spark.read.parquet(path))
    return df.select(*columns) if columns else df


def jsonl(spark: SparkSession, path: str, schema: str = schemas.EXAMPLES) -> DataFrame:
    return _guard(path, lambda: spark.read.schema(schema).json(path))


def cases(spark: SparkSession, folder: str, prefer_slim: bool = True) -> DataFrame:
    """The slim Parquet if it is there, else the JSON lines."""
    from colloq.operators.conversations import from_slim

    if prefer_slim:
        try:
            return from_slim(parquet(spark, f"{folder}/slim.parquet"))
        except MissingSourceError:
            pass
    return jsonl(spark, f"{folder}/cases.jsonl", schemas.CASES)


def tsv_labels(spark: SparkSession, path: str, domain: Sequence[str]) -> DataFrame:
    """id, label and free text (which may hold tabs) per line; a label outside the domain is an error."""
    lines = _guard(path, lambda: spark.read.text(path)).where(F.trim("value") != "")
    parts = F.split("value", "\t", 3)
    rows = lines.select(F.get(parts, F.lit(0)).alias("example_id"), F.get(parts, F.lit(1)).alias("label"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("reason"))
    ok = F.coalesce(F.col("label").isin(*domain), F.lit(False))
    return rows.where(F.coalesce(F.assert_true(ok, F.concat(F.lit("label outside the domain: "), F.coalesce("label", F.lit("none")))).isNull(), F.lit(True)))


def tsv_sheets(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Several review sheets as one table."""
    out = None
    for p in paths:
        part = csv(spark, p, schema, sep="\t")
        out = part if out is None else out.unionByName(part)
    return out


def id_document(path: str, key: str = "conversation_ids") -> list:
    """The ids of a JSON document: under ``key``, or the document itself if it is a list."""
    found = json.loads(Path(path).read_text())
    return list(found[key]) if isinstance(found, dict) else list(found)


def label_table(spark: SparkSession, names: Sequence[str], special: Sequence[str] = ("none", "other_unclear")) -> DataFrame:
    """(label, ord): an ordered vocabulary with the special labels last."""
    return spark.createDataFrame([(n, i) for i, n in enumerate([*names, *special])], "label string, ord int")


def taxonomy(path: str) -> list[str]:
    """Intent ids of a YAML list of ``- id: name`` entries, in order."""
    return [line.split(":", 1)[1].strip().strip("'\"") for line in Path(path).read_text().splitlines() if line.strip().startswith("- id:")]


def dict_rows(spark: SparkSession, rows: dict, columns: Sequence[str]) -> DataFrame:
    """A Python dict of key -> tuple as a table."""
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], list(columns))


def latest_timestamp(spark: SparkSession, path: str, field: str = "created_at", default: str | None = None) -> str | None:
    """The largest well-formed timestamp text of one JSON field; malformed lines count as absent."""
    lines = spark.read.text(path).select(F.get_json_object("value", f"$.{field}").alias("ts"))
    return lines.where(has_message_time_shape(F.col("ts"))).agg(F.coalesce(F.max("ts"), F.lit(default)).alias("ts")).first()["ts"]


def load_env(path: str) -> dict[str, str]:
    """KEY=value lines of a file into the environment, which wins; comments and blanks are skipped."""
    found = {}
    for line in Path(path).read_text().splitlines() if Path(path).exists() else []:
        key, sign, value = line.strip().partition("=")
        if sign and key and not key.startswith("#"):
            found[key.strip()] = value.strip().strip("'\"")
            os.environ.setdefault(key.strip(), found[key.strip()])
    return found


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and stored there first if it is missing."""
    try:
        return parquet(spark, path)
    except MissingSourceError:
        make().write.mode("errorifexists").parquet(path)
        return parquet(spark, path)
