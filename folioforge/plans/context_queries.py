"""Queries that combine several operators: statement loads and enriched positions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from folioforge.operators import enrich as E
from folioforge.operators import statements as ST
from folioforge.operators.lineage import written_once
from folioforge.plans import views as V
from folioforge.plans.beta_queries import _FAR, _NEAR, _UPPER, BETA  # noqa: F401
from folioforge.plans.fundamental_queries import FUND
from folioforge.plans.holding_queries import _latest
from folioforge.plans.registry import query, show
from folioforge.plans.technical_queries import TECH

# --- statement loads --------------------------------------------------------------------------


def _load(spark, sf):
    """Stored: yearly statements up to 1999. Loaded: 1999 again, all later years, and the overlapping ones."""
    rows = V.trades_overlap(spark, sf)
    name = F.substring_index("statement_id", "-", -1)
    stored = rows.where((name != "overlap") & (name <= "1999"))
    return stored, rows.where(name >= "1999")


@query("replace_statement_trades", ("trades_overlap", "statements"), """
SELECT statement_id, count(*) AS trades, sum(quantity)::DOUBLE AS quantity FROM trades_overlap
WHERE statement_id NOT LIKE '%overlap' GROUP BY 1""")
def replace_statement_trades(spark, sf):
    stored, incoming = _load(spark, sf)
    out = ST.replace_trades(stored, incoming, V.statements(spark, sf))
    return show(out.groupBy("statement_id").agg(F.count("*").alias("trades"), F.sum("quantity").alias("quantity")))


@query("statement_load_counts", ("trades_overlap", "statements"), """
SELECT statement_id, count(*) AS received, count(*) FILTER (WHERE statement_id NOT LIKE '%overlap') AS stored,
 count(*) FILTER (WHERE statement_id LIKE '%overlap') AS skipped
FROM trades_overlap WHERE statement_id LIKE '%overlap' OR CAST(split_part(statement_id, '-', 2) AS INT) >= 1999 GROUP BY 1""")
def statement_load_counts(spark, sf):
    stored, incoming = _load(spark, sf)
    loaded = incoming.select("statement_id").distinct()
    others = stored.join(loaded, "statement_id", "left_anti")
    return show(ST.load_counts(incoming, ST.accepted_trades(incoming, others)))


@query("replace_statement_positions", ("positions_overlap",), """
SELECT statement_id, symbol, (quantity * CASE WHEN statement_date = DATE '2000-12-31' THEN 2 ELSE 1 END)::DOUBLE AS quantity
FROM positions_overlap""")
def replace_statement_positions(spark, sf):
    stored = V.positions_overlap(spark, sf)
    incoming = stored.where(F.col("statement_date") == F.lit(date(2000, 12, 31))).withColumn(
        "quantity", (F.col("quantity") * 2).cast("decimal(18,4)"))
    return show(ST.replace_positions(stored, incoming).select("statement_id", "symbol", "quantity"))


@query("cascade_delete_counts", ("statements", "positions_overlap", "trades_overlap"), """
SELECT 'positions' AS child, count(*) AS rows FROM positions_overlap WHERE statement_id NOT LIKE '%-1998'
UNION ALL SELECT 'statements', count(*) FROM statements WHERE id NOT LIKE '%-1998'
UNION ALL SELECT 'trades', count(*) FROM trades_overlap WHERE statement_id NOT LIKE '%-1998'""")
def cascade_delete_counts(spark, sf):
    statements = V.stored(V.statements, spark, sf)
    doomed = statements.where(F.year("period_end") == 1998).select("id")
    parts = ST.cascade_delete(statements, V.positions_overlap(spark, sf), V.trades_overlap(spark, sf), doomed)
    names = ("statements", "positions", "trades")
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("child"), "rows") for n, t in zip(names, parts)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- enriched positions -----------------------------------------------------------------------

_START = (V.AS_OF - timedelta(days=E.LOOKBACK_DAYS)).isoformat()
_RECENT = {
    "recent_prices": (["daily_prices"], f"SELECT * FROM daily_prices WHERE price_date BETWEEN DATE '{_START}' AND DATE '2001-12-31'"),
    "series": (["recent_prices"], TECH["series"][1].replace("daily_prices", "recent_prices")),
}
CONTEXT = {
    **FUND, **BETA, **TECH, **_RECENT,
    "beta_rows": (["recent_prices"], BETA["beta_rows"][1].replace("daily_prices", "recent_prices")),
    "beta_wide": (["betas"], """
SELECT symbol, max(beta) FILTER (WHERE benchmark = 'MKT') AS beta_mkt, max(beta) FILTER (WHERE benchmark = 'STD') AS beta_std FROM betas GROUP BY 1"""),
    "last_close": (["daily_prices"], "SELECT symbol, arg_max(close, price_date)::DOUBLE AS current_price FROM daily_prices GROUP BY 1"),
    "recent_vol": (["series"], """
SELECT symbol, CASE WHEN any_value(n) >= 21 THEN stddev_samp(ln(c / p)) FILTER (WHERE n - rn < 20) * sqrt(252) END AS vol FROM series GROUP BY 1"""),
    "enriched": (["positions_latest", "last_close", "recent_vol", "beta_wide"], f"""
SELECT *, CASE WHEN per_share > 0 THEN beta_mkt * delta * current_price / per_share END AS option_beta_mkt,
 CASE WHEN per_share > 0 THEN beta_std * delta * current_price / per_share END AS option_beta_std
FROM (SELECT z.*, CASE WHEN ok THEN CASE WHEN z."right" = 'C' THEN nx ELSE nx - 1 END END AS delta
FROM (SELECT y.*, CASE WHEN d1 > 0 THEN 1 - ({_UPPER}) ELSE {_UPPER} END AS nx FROM (SELECT x.*, abs(d1) AS a FROM (
 SELECT w.*, CASE WHEN ok THEN (ln(current_price / strike::DOUBLE) + (0.045::DOUBLE + sigma * sigma * 0.5::DOUBLE) * (dte / 365::DOUBLE)) / (sigma * sqrt(dte / 365::DOUBLE)) END AS d1
 FROM (SELECT p.*, CASE WHEN asset_class = 'OPT' THEN split_part(p.symbol, ' ', 1) ELSE p.symbol END AS underlying, current_price, beta_mkt, beta_std,
  coalesce(nullif(vol, 0), 0.3)::DOUBLE AS sigma, date_diff('day', DATE '2001-12-31', expiry) AS dte,
  abs(market_value)::DOUBLE / nullif(abs(quantity)::DOUBLE * 100, 0) AS per_share,
  CASE WHEN "right" = 'C' THEN (current_price - strike::DOUBLE) / strike::DOUBLE ELSE (strike::DOUBLE - current_price) / strike::DOUBLE END AS moneyness,
  CASE WHEN cost_basis <> 0 THEN CASE WHEN "right" = 'C' THEN strike::DOUBLE + cost_basis::DOUBLE / 100 / quantity::DOUBLE
   ELSE strike::DOUBLE - cost_basis::DOUBLE / 100 / quantity::DOUBLE END END AS breakeven,
  coalesce(asset_class = 'OPT' AND current_price > 0 AND strike > 0 AND expiry > DATE '2001-12-31', FALSE) AS ok
 FROM positions_latest p LEFT JOIN last_close c ON c.symbol = CASE WHEN asset_class = 'OPT' THEN split_part(p.symbol, ' ', 1) ELSE p.symbol END
 LEFT JOIN recent_vol v ON v.symbol = c.symbol LEFT JOIN beta_wide b ON b.symbol = c.symbol) w) x) y) z) g"""),
}

_POSITION_OUT = ["account_id", "symbol", "underlying", "asset_class", "dte", "moneyness", "breakeven", "current_price", "sigma", "delta",
                 "option_beta_mkt", "option_beta_std"]
_DIGITS = {"moneyness": 8, "sigma": 8, "delta": 8, "option_beta_mkt": 6, "option_beta_std": 6}


@query("enriched_positions", ("enriched",), "SELECT " + ", ".join(
    f"round({c}, {_DIGITS[c]}) AS {c}" if c in _DIGITS else c for c in _POSITION_OUT) + " FROM enriched", extra=CONTEXT)
def enriched_positions(spark, sf):
    rows = E.enriched_positions(_latest(spark, sf), V.stored(V.daily_prices, spark, sf), V.AS_OF, V.BENCHMARKS)
    return show(rows.select(*_POSITION_OUT), **_DIGITS)


@query("underlying_context", ("positions_latest", "last_close", "recent_vol", "tech_scored", "latest", "betas", "trades_base"), """
SELECT e.account_id, e.underlying, e.mv AS market_value, current_price, round(vol, 8) AS realized_vol, rsi_14_score, sma_trend_score, macd_score,
 above_sma50, f.n AS metrics, f.revenue, t.n AS recent_trades, t.newest, round(b.beta, 8) AS beta_mkt, round(b.beta * e.mv, 2) AS dollar_beta_mkt
FROM (SELECT account_id, CASE WHEN asset_class = 'OPT' THEN split_part(symbol, ' ', 1) ELSE symbol END AS underlying,
  sum(abs(market_value))::DOUBLE AS mv FROM positions_latest GROUP BY 1, 2) e
LEFT JOIN last_close c ON c.symbol = underlying LEFT JOIN recent_vol v ON v.symbol = underlying LEFT JOIN tech_scored s ON s.symbol = underlying
LEFT JOIN (SELECT symbol, count(*) AS n, max(metric_value::DOUBLE) FILTER (WHERE metric_name = 'revenue') AS revenue FROM latest GROUP BY 1) f ON f.symbol = underlying
LEFT JOIN (SELECT * FROM betas WHERE benchmark = 'MKT') b ON b.symbol = underlying
LEFT JOIN (SELECT account_id, p_brand, least(count(*), 20) AS n, CAST(max(trade_date) AS DATE) AS newest FROM trades_base GROUP BY 1, 2) t
 ON t.account_id = e.account_id AND t.p_brand = underlying""", extra=CONTEXT, days=("newest",))
def underlying_context(spark, sf):
    rows = E.underlying_context(
        written_once(_latest(spark, sf)), V.trades(spark, sf), V.stored(V.daily_prices, spark, sf), V.stock_metrics(spark, sf), None,
        V.AS_OF, V.BENCHMARKS)
    return show(rows.select(
        "account_id", "underlying", "market_value", "current_price", "realized_vol", "rsi_14_score", "sma_trend_score", "macd_score",
        "above_sma50", F.size("fundamentals").alias("metrics"), F.try_element_at("fundamentals", F.lit("revenue")).alias("revenue"),
        F.size("recent_trades").alias("recent_trades"), F.get("recent_trades", F.lit(0))["day"].alias("newest"),
        "beta_mkt", "dollar_beta_mkt"), realized_vol=8, beta_mkt=8, dollar_beta_mkt=2)
