"""Registered queries against their SQL on the smallest data set (all of them: tools/check.py)."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
CHOSEN = ["T1_token_dim", "T16_current_liquidity", "T19_merge_outcomes", "R1_red_alerts", "J1_resolve_pair", "J3_price_asof", "W7_idle_expiry", "C4_serial_creators", "E3_eligibility",
          "F6_tradable_series", "N11_normalize_meme", "U2_dedup_exact", "S6_retention_plan", "Q2_auc", "P20_stratified_sample"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_every_query_has_sql_and_the_flagship_runs(spark):
    from drainwatch.catalog import ORACLE, QUERIES

    # The way from frames to records has its own tests on hand-made feeds.
    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(oracle_sql()) and set(QUERIES) <= set(queries())
    assert entry(spark).count() > 0
