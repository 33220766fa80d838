"""Registered queries against their SQL on the smallest tables, and the rows-only ones for shape."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Every third checked query, unless all are asked for; tools/check.py runs all of them.
NAMES = sorted(SQL) if os.environ.get("ALL_QUERIES") else sorted(SQL)[::3]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_values(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_checks():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 240
    assert norm(None) == "~"


def test_mining_negatives_hold_their_wording(spark):
    rows = QUERIES["smp_20_pattern_negatives"](spark, SF).collect()
    assert {r.kind for r in rows} >= {"synonym", "author", "ancestor"}
    assert all(r.first.lower() != r.second.lower() for r in rows)


def test_model_queries(spark):
    parts = {r.split for r in QUERIES["ml_01_text_features"](spark, SF).collect()}
    assert "train" in parts
    rounds = [r["round"] for r in QUERIES["ml_06_active_learning"](spark, SF).collect()]
    assert len(rounds) >= 60 and set(rounds) >= {0}
