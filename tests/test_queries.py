"""Registered queries against their SQL at the smallest scale; ``check.py`` runs all of them."""

import os

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from check import TABLES, compare

needs_data = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no test tables")
SAMPLE = ("latest_in_interval", "case_cohort", "control_cohort", "case_software", "case_hardware", "interval_join",
          "ad_activity_case", "exact_quantiles", "multi_hot", "prevalence", "split_60_20_20", "report", "auc")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMOKE_DIR}/{t}.parquet'")
    return c


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@needs_data
def test_every_check_sql_binds(con):
    for sql in oracle_sql().values():
        con.execute(f"explain {sql}")


@needs_data
def test_entry_runs(spark):
    assert entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SMOKE_DIR)
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert compare(df.columns, [tuple(r) for r in df.collect()], cols, cur.fetchall()) is None
