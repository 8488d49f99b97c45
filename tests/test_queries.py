"""Every registered query with SQL against DuckDB on the smallest tables, and the rest for rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom.operators import estimators
from sparkloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"q_ctmc"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, (int, float, np.number)) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    return str(v).removesuffix(" 00:00:00")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.SQL])
def test_matches_sql(spark, duck, name):
    found, told = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(found.columns) == sorted(told.columns)
    assert rows(found) == rows(told)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL and n not in SLOW])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns
    registry.QUERIES[name](spark, SF).collect()


def test_bootstrap_draws(spark):
    found = registry.QUERIES["q_bootstrap"](spark, SF).first()
    assert 500 < found["valid"] <= 2000
    assert found == estimators.kappa_bootstrap(spark.read.parquet(f"{SF}/labels.parquet"), "quality", "toxic").first()
