"""Every registered query against its SQL on the smallest tables."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import opsframe.plans  # noqa: F401
from opsframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


#: Queries that SQL can't express, and the test that holds them against a plain computation.
PLAIN = {
    "v2_markdown_sections": "test_validation.test_sections_of_markdown", "s21_byte_batches": "test_signals.test_byte_batches_match_a_loop", "w15_ingest_queue_stream": "test_stateful.test_queue_against_a_loop",
}


def value(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


def rows(d):
    d = d[sorted(d.columns)]
    return sorted((tuple(value(v) for v in r) for r in d.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        module, test = PLAIN[name].split(".")
        assert len(got.columns) and hasattr(importlib.import_module(f"tests.{module}"), test)
        return
    want = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
