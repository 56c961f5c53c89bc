from datetime import date, datetime
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.operators import holdings as H
from folioforge.operators import reconcile as R
from folioforge.operators import statements as ST
from folioforge.operators import trades as T

POS = ("statement_id string, symbol string, asset_class string, quantity decimal(18,4), cost_basis decimal(18,4), market_price decimal(18,4),"
       " market_value decimal(18,4), unrealized_pnl decimal(18,4), statement_date date, expiry date, strike decimal(18,4), right string")
TRD = ("statement_id string, trade_date timestamp_ntz, symbol string, asset_class string, side string, quantity decimal(18,4),"
       " price decimal(18,4), realized_pnl decimal(18,4), commission decimal(18,4), expiry date, strike decimal(18,4), right string")
STM = "id string, account_id string, period_start date, period_end date, created_at date"
D1, D2, D3 = date(2026, 1, 31), date(2026, 2, 28), date(2026, 3, 31)


def pos(sid, day, symbol, qty, cls="STK", **opt):
    q = Decimal(qty)
    return (sid, symbol, cls, q, q * 10, Decimal(12), q * 12, q * 2, day, opt.get("expiry"), opt.get("strike"), opt.get("right"))


def trd(sid, when, symbol, side, qty, cls="STK", price=10, pnl=0, **opt):
    return (sid, when, symbol, cls, side, Decimal(qty), Decimal(price), Decimal(pnl), Decimal(-1), opt.get("expiry"), opt.get("strike"), opt.get("right"))


@pytest.fixture(scope="module")
def book(spark):
    opt = dict(cls="OPT", expiry=date(2026, 2, 20), strike=Decimal(48), right="C")
    statements = spark.createDataFrame([
        ("s1", "A", date(2026, 1, 1), D1, D1), ("s2", "A", date(2026, 2, 1), D2, D2), ("s3", "A", date(2026, 3, 1), D3, D3),
    ], STM)
    positions = spark.createDataFrame([
        pos("s1", D1, "AAPL", 100), pos("s1", D1, "GONE", 5), pos("s1", D1, "EEM 20FEB26 48 C", -2, **opt),
        pos("s2", D2, "AAPL", 170), pos("s2", D2, "NEW", 7), pos("s1", D2, "AAPL", 999),
        pos("s3", D3, "AAPL", 70), pos("s3", D3, "NEW", 7),
    ], POS)
    trades = spark.createDataFrame([
        trd("s2", datetime(2026, 2, 3, 10), "AAPL", "BOT", 50), trd("s2", datetime(2026, 2, 4, 10), "AAPL", "BOT", 30),
        trd("s2", datetime(2026, 2, 5, 10), "AAPL", "SLD", 10), trd("s3", datetime(2026, 2, 5, 10), "AAPL", "SLD", 10),
        # On the middle snapshot date, during the day: belongs to both pairs.
        trd("s2", datetime(2026, 2, 28, 9), "INTRA", "BOT", 3),
        trd("s3", datetime(2026, 3, 31, 23, 59, 59), "AAPL", "SLD", 1),
    ], TRD)
    return statements, positions, trades


def test_reconcile_pairs(book):
    statements, positions, trades = book
    rows = {(r.base_date, r.symbol): r for r in R.reconcile(trades, positions, statements).collect()}
    aapl = rows[(D1, "AAPL")]
    # The later statement's correction does not win: s2 was written after s1.
    assert (aapl.base_qty, aapl.reconstructed_qty, aapl.expected_qty, aapl.match, aapl.trades) == (100, 170, 170, True, 3)
    assert rows[(D2, "AAPL")].diff == 169 - 70 and not rows[(D2, "AAPL")].match
    assert rows[(D1, "GONE")].gap == "missing_from_target" and rows[(D1, "NEW")].gap == "missing_from_reconstruction"
    assert rows[(D1, "EEM 20FEB26 48 C")].suppressed and rows[(D2, "NEW")].match
    assert rows[(D1, "INTRA")].reconstructed_qty == 3 and rows[(D2, "INTRA")].reconstructed_qty == 3
    summary = {r.base_date: r for r in R.pair_summary(R.reconcile(trades, positions, statements)).collect()}
    assert not summary[D1].ok and summary[D1].missing_from_target == 2


def test_ledger_running_quantity(book):
    statements, positions, trades = book
    rows = R.ledger(trades, positions, statements).where((F.col("symbol") == "AAPL") & (F.col("base_date") == F.lit(D1)))
    assert [r.running_qty for r in rows.orderBy("trade_date").collect()] == [150, 180, 170]


def test_positions_dedup_and_latest(book):
    statements, positions, _ = book
    rows = H.positions_as_of(positions, statements, D2).collect()
    assert {r.symbol: r.quantity for r in rows} == {"AAPL": 170, "NEW": 7}
    assert {r.symbol for r in H.latest_positions(positions, statements).collect()} == {"AAPL", "NEW"}
    assert H.widest_period(statements).first().period_start == date(2026, 1, 1)


def test_trade_filters_and_boundaries(book):
    statements, _, trades = book
    got = T.trades_between(trades, statements, D2, D3)
    assert {r.symbol for r in got.collect()} == {"INTRA", "AAPL"}
    strict = T.trades_between(trades, statements, D2, D3, exclude_base_day=True)
    assert {r.symbol for r in strict.collect()} == {"AAPL"}
    assert T.filter_trades(trades, statements, statement_id="s3", account_id="nobody").count() == 2
    assert T.filter_trades(trades, statements, account_id="A", side="SLD").count() == 3
    assert T.dedup_trades(T.with_account(trades, statements)).count() == 5
    dup = {r.statement_id: (r.new_trades, r.dup_trades) for r in T.duplicate_counts(trades, trades, statements, book[1]).collect()}
    assert dup["s2"] == (3, 1) and dup["s3"] == (1, 1)


def test_statement_replacement(book):
    statements, positions, trades = book
    stored = trades.where(F.col("statement_id") == "s2")
    incoming = trades.where(F.col("statement_id") == "s3")
    out = ST.replace_trades(stored, incoming, statements)
    assert out.count() == 5 and out.where(F.col("statement_id") == "s3").count() == 1
    assert ST.replace_trades(out.select(*trades.columns), incoming, statements).count() == 5
    assert ST.replace_positions(positions, positions.where("statement_id = 's3'")).count() == positions.count()
    doomed = statements.where("id = 's1'").select("id")
    s, p, t = ST.cascade_delete(statements, positions, trades, doomed)
    assert (s.count(), p.count(), t.count()) == (2, 4, 6)


def test_pnl_statistics_match_pandas(spark):
    values = [120.0, -40.5, 0.0, 33.25, -80.0, 7.0, 250.0, -12.75, 64.0, 0.0]
    rows = [trd("s", datetime(2026, 1, 1 + i), "AAPL X" if i % 2 else "MSFT", "SLD", 1, pnl=v) for i, v in enumerate(values)]
    trades = spark.createDataFrame(rows, TRD)
    closing = pd.Series([v for v in values if v])
    got = [r.n for r in T.pnl_histogram(trades).orderBy("bin").collect()]
    assert got == closing.value_counts(bins=20).sort_index().tolist()
    stats = T.win_loss_stats(trades).first()
    wins, losses = closing[closing > 0], closing[closing < 0]
    assert stats.profit_factor == pytest.approx(wins.sum() / -losses.sum()) and stats.win_rate == pytest.approx(len(wins) / len(closing) * 100)
    assert stats.avg_loss == pytest.approx(losses.mean()) and stats.largest_loss == losses.min()
    only_wins = T.win_loss_stats(trades.where("realized_pnl >= 0")).first()
    assert only_wins.profit_factor == float("inf") and only_wins.avg_loss == 0
    assert T.win_loss_stats(trades.where("realized_pnl = 0")).count() == 0
    assert {r.symbol for r in T.pnl_by_symbol(trades).collect()} == {"AAPL", "MSFT"}
    one = T.pnl_histogram(trades.where("realized_pnl = 7")).where("n > 0").first()
    assert one.n == 1


def test_consolidation_fallbacks(spark):
    rows = spark.createDataFrame([
        ("s", "AAPL", "STK", Decimal(10), Decimal(15), None, None, None, D1, None, None, None),
        ("s", "AAPL 20260417 200 C", "OPT", Decimal(-2), Decimal(500), None, None, None, D1, date(2026, 4, 17), Decimal(200), "C"),
    ], POS)
    full = {r.symbol: r for r in H.consolidate(rows).collect()}
    assert full["AAPL"].market_value == 150 and full["AAPL 20260417 200 C"].market_value == 40000
    assert full["AAPL 20260417 200 C"].breakeven == pytest.approx(202.5)
    report = {r.symbol: r for r in H.consolidate(rows, option_notional=False).collect()}
    assert report["AAPL 20260417 200 C"].market_value == 1000


def test_written_trades_serve_all_views(spark):
    from folioforge.plans import views as V

    sf = "/root/testdata/sf0.001"
    base = V.stored(V.trades_base, spark, sf)
    for view in (V.trades, V.trades_overlap, V.positions, V.positions_overlap):
        shared, own = view(spark, sf, base), view(spark, sf)
        assert shared.columns == own.columns and shared.count() == own.count() > 0
        assert shared.exceptAll(own).isEmpty() and own.exceptAll(shared).isEmpty()
    # The shared rows are read without a join, and lines meet the wide parts after their orders.
    assert "Join" not in V.trades_overlap(spark, sf, base)._jdf.queryExecution().optimizedPlan().toString()
    plan = V.trades(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("l_partkey") < plan.index("o_orderkey")
