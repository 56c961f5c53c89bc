"""Registered queries against their SQL. FOLIOFORGE_ALL=1 runs every one, else a sample of each kind."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from folioforge.plans import catalog
from tools.check import TABLES, normal
from tools.plans import findings

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "pnl_by_symbol", "pnl_histogram", "trade_dedup", "duplicate_counts", "holdings_consolidated", "reconcile_all_pairs", "trade_ledger",
    "upsert_prices", "tech_ranking", "indicator_series", "option_adjusted_beta", "ttm_series", "split_normalized", "ratio_history",
    "valuation_snapshot", "facts_to_metrics", "parsed_trades", "replace_statement_trades", "underlying_context",
]
# One row per calendar day reaches this window.
DAY_BOUNDED = {"cumulative_pnl"}
NAMES = list(catalog.QUERIES) if os.environ.get("FOLIOFORGE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    if name not in DAY_BOUNDED:
        assert findings(df) == []
    got, want = normal(df.toPandas()), normal(con.execute(contract.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head(10).to_string()


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(contract.queries()) and set(catalog.ORACLE) <= set(contract.oracle_sql())
    assert contract.entry(spark).count() > 0
