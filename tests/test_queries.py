"""Every registered query against its SQL on the smallest driver tables."""

import glob
import importlib.util
import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from colloq.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(rows):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        if isinstance(x, (list, tuple)):
            return tuple(map(value, x))
        return str(x) if hasattr(x, "isoformat") else x

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = norm(df.select(*columns).collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == norm([[r[i] for i in at] for r in cursor.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_training_data_operators(monkeypatch):
    """Deleted, or without one of their packages: the other queries are all there."""
    for missing in ("colloq.llm", "xxhash"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith(("colloq.llm", "corpus_pipeline"))]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, missing, None)
            spec = importlib.util.spec_from_file_location("entry_again", entry.__file__)
            again = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(again)
            assert set(again.queries()) == set(QUERIES) and set(again.oracle_sql()) == set(SQL)
