"""Queries over trades: selection, deduplication, P&L statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from folioforge.operators import trades as T
from folioforge.plans import views as V
from folioforge.plans.registry import query, show


@query("trade_totals", ("trades",), """
SELECT sum(realized_pnl)::DOUBLE AS total_realized, sum(commission)::DOUBLE AS total_commission,
 count(*) AS trades FROM trades""")
def trade_totals(spark, sf):
    return show(T.trade_totals(V.trades(spark, sf)))


@query("daily_pnl", ("trades",), """
SELECT CAST(trade_date AS DATE) AS trade_day, sum(realized_pnl)::DOUBLE AS realized_pnl FROM trades GROUP BY 1""", days=("trade_day",))
def daily_pnl(spark, sf):
    return show(T.daily_pnl(V.trades(spark, sf)))


@query("cumulative_pnl", ("trades",), """
SELECT trade_day, pnl::DOUBLE AS realized_pnl, (sum(pnl) OVER (ORDER BY trade_day))::DOUBLE AS cumulative_pnl
FROM (SELECT CAST(trade_date AS DATE) AS trade_day, sum(realized_pnl) AS pnl FROM trades GROUP BY 1) d""", days=("trade_day",))
def cumulative_pnl(spark, sf):
    return show(T.cumulative_pnl(V.trades(spark, sf)))


_BY_SYMBOL = """
SELECT split_part(symbol, ' ', 1) AS symbol, sum(realized_pnl)::DOUBLE AS total_pnl, count(*) AS trades,
 count(*) FILTER (WHERE realized_pnl > 0) AS wins, round(sum(realized_pnl)::DOUBLE / count(*), 4) AS avg_pnl,
 sum(commission)::DOUBLE AS total_commission,
 round_even(count(*) FILTER (WHERE realized_pnl > 0) / count(*) * 100, 1) AS win_rate
FROM trades WHERE realized_pnl <> 0 GROUP BY 1"""


@query("pnl_by_symbol", ("trades",), _BY_SYMBOL)
def pnl_by_symbol(spark, sf):
    return show(T.pnl_by_symbol(V.trades(spark, sf)), avg_pnl=4)


@query("top_symbols_by_pnl", ("trades",), f"SELECT * FROM ({_BY_SYMBOL}) s ORDER BY total_pnl DESC, symbol LIMIT 10")
def top_symbols_by_pnl(spark, sf):
    return show(T.top_symbols(T.pnl_by_symbol(V.trades(spark, sf)), "total_pnl"), avg_pnl=4)


@query("win_loss_stats", ("trades",), """
SELECT closing_trades, winners, losers, round(winners / closing_trades * 100, 6) AS win_rate,
 round(gross_wins / winners, 4) AS avg_win, round(-gross_losses / losers, 4) AS avg_loss, gross_wins, gross_losses,
 round(CASE WHEN gross_losses > 0 THEN gross_wins / gross_losses ELSE 'inf'::DOUBLE END, 6) AS profit_factor,
 largest_win, largest_loss, round(commissions / gross_wins * 100, 6) AS commission_pct
FROM (SELECT count(*) FILTER (WHERE realized_pnl <> 0) AS closing_trades,
  count(*) FILTER (WHERE realized_pnl > 0) AS winners, count(*) FILTER (WHERE realized_pnl < 0) AS losers,
  sum(CASE WHEN realized_pnl > 0 THEN realized_pnl END)::DOUBLE AS gross_wins,
  abs(sum(CASE WHEN realized_pnl < 0 THEN realized_pnl END))::DOUBLE AS gross_losses,
  max(realized_pnl)::DOUBLE AS largest_win, min(realized_pnl)::DOUBLE AS largest_loss,
  abs(sum(commission))::DOUBLE AS commissions FROM trades) s""")
def win_loss_stats(spark, sf):
    return show(
        T.win_loss_stats(V.trades(spark, sf)),
        win_rate=6, avg_win=4, avg_loss=4, profit_factor=6, commission_pct=6,
    )


@query("pnl_histogram", ("trades",), """
SELECT b AS bin, round(lo + (hi - lo) * (b - 1) / 20, 4) AS bin_low, round(lo + (hi - lo) * b / 20, 4) AS bin_high,
 coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, 21)) AS b) bins
CROSS JOIN (SELECT min(realized_pnl)::DOUBLE AS lo, max(realized_pnl)::DOUBLE AS hi FROM trades WHERE realized_pnl <> 0) x
LEFT JOIN (SELECT greatest(1, ceil((v - lo) * 20 / (hi - lo)))::BIGINT AS bin, count(*) AS n
 FROM (SELECT realized_pnl::DOUBLE AS v FROM trades WHERE realized_pnl <> 0) t
 CROSS JOIN (SELECT min(realized_pnl)::DOUBLE AS lo, max(realized_pnl)::DOUBLE AS hi FROM trades WHERE realized_pnl <> 0) y
 GROUP BY 1) c ON c.bin = b""")
def pnl_histogram(spark, sf):
    return show(T.pnl_histogram(V.trades(spark, sf)), bin_low=4, bin_high=4)


@query("totals_by_date_preset", ("trades",), """
SELECT preset, sum(realized_pnl)::DOUBLE AS total_realized, sum(commission)::DOUBLE AS total_commission, count(*) AS trades
FROM trades JOIN (VALUES ('1W', DATE '2001-12-31' - 7), ('1M', DATE '2001-12-31' - 30), ('3M', DATE '2001-12-31' - 90),
 ('1Y', DATE '2001-12-31' - 365), ('YTD', DATE '2001-01-01'), ('All', NULL)) p(preset, start)
 ON start IS NULL OR (CAST(trade_date AS DATE) >= start AND CAST(trade_date AS DATE) <= DATE '2001-12-31') GROUP BY 1""")
def totals_by_date_preset(spark, sf):
    return show(T.totals_by_preset(V.trades(spark, sf), V.AS_OF))


_TRADE_OUT = """statement_id, strftime(trade_date, '%Y-%m-%d %H:%M:%S') AS trade_time, symbol, asset_class, side,
 quantity::DOUBLE AS quantity, price::DOUBLE AS price, proceeds::DOUBLE AS proceeds, realized_pnl::DOUBLE AS realized_pnl"""


def trade_output(df):
    return show(df.select(
        "statement_id", F.date_format("trade_date", "yyyy-MM-dd HH:mm:ss").alias("trade_time"), "symbol",
        "asset_class", "side", "quantity", "price", "proceeds", "realized_pnl",
    ))


@query("trades_filtered", ("trades", "statements"), f"""
SELECT {_TRADE_OUT} FROM trades
WHERE statement_id IN (SELECT id FROM statements WHERE account_id = 'U3') AND asset_class = 'OPT' AND side = 'SLD'
 AND trade_date >= TIMESTAMP '1997-03-01' AND trade_date <= TIMESTAMP '1999-06-30 23:59:59'""")
def trades_filtered(spark, sf):
    return trade_output(T.filter_trades(
        V.trades(spark, sf), V.statements(spark, sf), account_id="U3", asset_class="OPT", side="SLD",
        date_from=date(1997, 3, 1), date_to=date(1999, 6, 30),
    ).orderBy(F.col("trade_date").desc_nulls_last()))


@query("trades_between", ("trades_overlap", "statements"), f"""
SELECT account_id, {_TRADE_OUT.replace('statement_id, ', 'statement_id, ', 1)} FROM (
 SELECT t.*, account_id, row_number() OVER (PARTITION BY account_id, trade_date, symbol, asset_class, side, quantity, price
  ORDER BY statement_id) AS rn FROM trades_overlap t JOIN statements s ON s.id = t.statement_id
 WHERE trade_date > TIMESTAMP '1997-12-31' AND trade_date <= TIMESTAMP '1998-12-31 23:59:59') d WHERE rn = 1""")
def trades_between(spark, sf):
    out = T.trades_between(
        V.trades_overlap(spark, sf), V.statements(spark, sf), date(1997, 12, 31), date(1998, 12, 31)
    )
    return show(out.select(
        "account_id", "statement_id", F.date_format("trade_date", "yyyy-MM-dd HH:mm:ss").alias("trade_time"),
        "symbol", "asset_class", "side", "quantity", "price", "proceeds", "realized_pnl",
    ))


@query("trade_dedup", ("trades_overlap", "statements"), """
SELECT account_id, count(*) AS kept, sum(quantity)::DOUBLE AS quantity, min(statement_id) AS first_statement FROM (
 SELECT account_id, trade_date, symbol, asset_class, side, quantity, price, min(statement_id) AS statement_id
 FROM trades_overlap t JOIN statements s ON s.id = t.statement_id GROUP BY ALL) d GROUP BY 1""")
def trade_dedup(spark, sf):
    kept = T.dedup_trades(T.with_account(V.trades_overlap(spark, sf), V.statements(spark, sf)))
    return show(kept.groupBy("account_id").agg(
        F.count("*").alias("kept"), F.sum("quantity").alias("quantity"),
        F.min("statement_id").alias("first_statement"),
    ))


@query("duplicate_counts", ("trades_overlap", "positions_overlap", "statements"), """
SELECT coalesce(c.statement_id, p.statement_id) AS statement_id, coalesce(new_trades, 0) AS new_trades,
 coalesce(dup_trades, 0) AS dup_trades, coalesce(new_positions, 0) AS new_positions, CAST(0 AS BIGINT) AS dup_positions
FROM (SELECT statement_id, count(*) FILTER (WHERE dup) AS dup_trades, count(*) FILTER (WHERE NOT dup) AS new_trades
 FROM (SELECT statement_id, count(DISTINCT statement_id) OVER (PARTITION BY account_id, trade_date, symbol, asset_class,
   side, quantity, price) > 1 AS dup FROM trades_overlap t JOIN statements s ON s.id = t.statement_id) x GROUP BY 1) c
FULL JOIN (SELECT statement_id, count(*) AS new_positions FROM positions_overlap GROUP BY 1) p
 ON c.statement_id = p.statement_id""")
def duplicate_counts(spark, sf):
    stored = V.trades_overlap(spark, sf)
    return show(T.duplicate_counts(stored, stored, V.statements(spark, sf), V.positions_overlap(spark, sf)))
