"""Every query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from trivalent import catalog


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iuf" or str(df[c].dtype).startswith("Int"):
            df[c] = df[c].astype("float64").round(6)
    return sorted(str(r) for r in df.astype(object).where(df.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_works_without_the_other_package(spark, sf, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert entry.entry(spark).count() > 0
