"""The registry as a whole, and a spread of queries against their SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, rows_of

SAMPLE = ["s1_bars_scan", "f9_feature_bundle", "t1_asof_join", "l6_walk_barriers", "x6_x8_snapshots", "h3_compare_quarters", "i1_insider_features", "e1_insider_cluster_events",
          "v1_per_date_metrics", "p1_monthly_portfolio", "d2_detect_sections", "r6_weighted_view"]


def test_every_sql_belongs_to_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150 and len(o) > 130


def test_flagship_has_rows(spark, sf):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(want_cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want_cols, want)
