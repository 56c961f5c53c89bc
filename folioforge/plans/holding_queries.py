"""Queries over statements, positions and daily bars."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from folioforge.functions.instruments import first_token, underlying
from folioforge.operators import holdings as H
from folioforge.operators import keyed as K
from folioforge.operators import prices as P
from folioforge.operators import reconcile as R
from folioforge.operators.scans import share_of_total
from folioforge.operators.trades import with_account
from folioforge.plans import views as V
from folioforge.plans.registry import query, show

# --- statements -------------------------------------------------------------------------------


@query("statements_newest", ("statements",),
       "SELECT id, account_id, period_start, period_end, base_currency, created_at FROM statements",
       days=("period_start", "period_end", "created_at"))
def statements_newest(spark, sf):
    return show(H.newest_statements(V.statements(spark, sf)))


@query("account_ids", ("statements",), "SELECT DISTINCT account_id FROM statements")
def account_ids(spark, sf):
    return H.account_ids(V.statements(spark, sf))


@query("widest_period", ("statements",), """
SELECT account_id, min(period_start) AS period_start, max(period_end) AS period_end FROM statements GROUP BY 1""",
       days=("period_start", "period_end"))
def widest_period(spark, sf):
    return show(H.widest_period(V.statements(spark, sf)))


@query("snapshot_dates", ("statements", "positions_overlap"), """
SELECT DISTINCT account_id, statement_date FROM positions_overlap JOIN statements ON id = statement_id""",
       days=("statement_date",))
def snapshot_dates(spark, sf):
    return show(H.snapshot_dates(V.positions_overlap(spark, sf), V.statements(spark, sf)))


@query("portfolio_symbols", ("statements", "positions_overlap"), """
SELECT DISTINCT account_id, symbol FROM positions_overlap JOIN (
 SELECT account_id, arg_max(id, (period_end, created_at, id)) AS id FROM statements GROUP BY 1) s ON s.id = statement_id
WHERE asset_class IN ('STK', 'ETF')""")
def portfolio_symbols(spark, sf):
    return H.portfolio_symbols(V.positions_overlap(spark, sf), V.statements(spark, sf))


@query("portfolio_and_benchmark_symbols", ("statements", "positions_overlap"), """
SELECT DISTINCT symbol FROM positions_overlap JOIN (
 SELECT account_id, arg_max(id, (period_end, created_at, id)) AS id FROM statements GROUP BY 1) s ON s.id = statement_id
WHERE asset_class IN ('STK', 'ETF') UNION SELECT 'MKT' UNION SELECT 'STD'""")
def portfolio_and_benchmark_symbols(spark, sf):
    held = H.portfolio_symbols(V.positions_overlap(spark, sf), V.statements(spark, sf)).select("symbol")
    bench = spark.createDataFrame([(b,) for b in V.BENCHMARKS], "symbol string")
    return held.unionByName(bench).distinct()


# --- positions --------------------------------------------------------------------------------

_POS_OUT = """symbol, asset_class, quantity::DOUBLE AS quantity, cost_basis::DOUBLE AS cost_basis,
 market_value::DOUBLE AS market_value, statement_date"""
DEDUP = {
    "positions_dedup": (["positions_overlap", "statements"], """
SELECT * FROM (SELECT p.*, account_id, row_number() OVER (
  PARTITION BY account_id, statement_date, symbol, CASE WHEN asset_class = 'OPT' THEN expiry END,
   CASE WHEN asset_class = 'OPT' THEN strike END, CASE WHEN asset_class = 'OPT' THEN "right" END
  ORDER BY created_at DESC, statement_id DESC) AS rn
 FROM positions_overlap p JOIN statements s ON s.id = p.statement_id) d WHERE rn = 1"""),
    "positions_latest": (["positions_dedup"], """
SELECT d.* FROM positions_dedup d JOIN (SELECT account_id, max(statement_date) AS statement_date FROM positions_dedup GROUP BY 1) m
 USING (account_id, statement_date)"""),
}


def _dedup(spark, sf):
    return H.dedup_positions(V.positions_overlap(spark, sf), V.statements(spark, sf))


def _latest(spark, sf):
    return H.latest_positions(V.stored(V.positions_overlap, spark, sf), V.statements(spark, sf))


@query("positions_of_statement", ("positions_overlap",), f"""
SELECT {_POS_OUT} FROM positions_overlap WHERE statement_id = 'U4-1999'""", days=("statement_date",))
def positions_of_statement(spark, sf):
    rows = V.positions_overlap(spark, sf).where(F.col("statement_id") == "U4-1999")
    return show(rows.select("symbol", "asset_class", "quantity", "cost_basis", "market_value", "statement_date"))


@query("positions_as_of", ("positions_dedup",), f"""
SELECT account_id, statement_id, {_POS_OUT} FROM positions_dedup WHERE statement_date = DATE '1999-12-31'""",
       extra=DEDUP, days=("statement_date",))
def positions_as_of(spark, sf):
    rows = H.positions_as_of(V.positions_overlap(spark, sf), V.statements(spark, sf), date(1999, 12, 31))
    return show(rows.select("account_id", "statement_id", "symbol", "asset_class", "quantity", "cost_basis", "market_value", "statement_date"))


@query("latest_positions", ("positions_latest",), f"SELECT account_id, statement_id, {_POS_OUT} FROM positions_latest",
       extra=DEDUP, days=("statement_date",))
def latest_positions(spark, sf):
    return show(_latest(spark, sf).select(
        "account_id", "statement_id", "symbol", "asset_class", "quantity", "cost_basis", "market_value", "statement_date"))


@query("position_fingerprints", ("positions_overlap", "statements"), """
SELECT DISTINCT account_id, symbol, asset_class, statement_date, expiry, strike::DOUBLE AS strike, "right"
FROM positions_overlap JOIN statements ON id = statement_id""", days=("statement_date", "expiry"))
def position_fingerprints(spark, sf):
    return show(H.position_fingerprints(V.positions_overlap(spark, sf), V.statements(spark, sf)))


_CONSOLIDATED = """
SELECT account_id, symbol, market_value, total_cost, quantity, asset_class, strike, "right",
 CASE WHEN asset_class <> 'OPT' THEN total_cost / quantity WHEN "right" = 'C' THEN strike + total_cost / quantity / 100
  ELSE strike - total_cost / quantity / 100 END AS breakeven,
 round(market_value / sum(market_value) OVER (PARTITION BY account_id) * 100, 6) AS pct_of_account
FROM (SELECT account_id, symbol, sum(coalesce(abs(market_value), {fallback}))::DOUBLE AS market_value,
 sum(abs(cost_basis))::DOUBLE AS total_cost, sum(abs(quantity))::DOUBLE AS quantity, min(asset_class) AS asset_class,
 min(strike)::DOUBLE AS strike, min("right") AS "right" FROM positions_latest GROUP BY 1, 2) g"""


@query("holdings_consolidated", ("positions_latest",), _CONSOLIDATED.format(
    fallback="CASE WHEN asset_class = 'OPT' THEN strike * 100 * abs(quantity) ELSE abs(quantity) * cost_basis END"),
    extra=DEDUP)
def holdings_consolidated(spark, sf):
    return show(H.consolidate(_latest(spark, sf), ("account_id",)), market_value=4, pct_of_account=6)


@query("report_consolidated", ("positions_latest",), """
SELECT symbol, market_value, quantity, round(market_value / sum(market_value) OVER () * 100, 6) AS pct_of_account
FROM (SELECT symbol, sum(coalesce(abs(market_value), abs(quantity) * cost_basis))::DOUBLE AS market_value,
 sum(abs(quantity))::DOUBLE AS quantity FROM positions_latest GROUP BY 1) g""", extra=DEDUP)
def report_consolidated(spark, sf):
    rows = H.consolidate(_latest(spark, sf), (), option_notional=False)
    return show(rows.select("symbol", "market_value", "quantity", "pct_of_account"), market_value=4, pct_of_account=6)


@query("holdings_totals", ("positions_latest",), """
SELECT account_id, sum(market_value)::DOUBLE AS total_market_value, sum(unrealized_pnl)::DOUBLE AS total_unrealized,
 sum(abs(cost_basis))::DOUBLE AS total_cost_value, count(*) AS positions, bool_or(market_value IS NOT NULL) AS has_market_data
FROM positions_latest GROUP BY 1""", extra=DEDUP)
def holdings_totals(spark, sf):
    return show(H.headline_totals(_latest(spark, sf), ("account_id",)))


@query("holdings_by_class", ("positions_latest",), """
SELECT account_id, asset_class, symbol, quantity::DOUBLE AS quantity, cost_basis::DOUBLE AS cost_basis,
 count(*) OVER (PARTITION BY account_id, asset_class) AS class_rows,
 CASE asset_class WHEN 'STK' THEN 'Stocks' WHEN 'OPT' THEN 'Options' ELSE 'ETFs' END AS class_label
FROM positions_latest""", extra=DEDUP)
def holdings_by_class(spark, sf):
    return show(H.detail_by_class(_latest(spark, sf)).select(
        "account_id", "asset_class", "symbol", "quantity", "cost_basis", "class_rows", "class_label"))


_UNREALIZED = """
SELECT symbol, unrealized_pnl, market_value, positions, quantity, round(abs(wbe / weight), 4) AS breakeven
FROM (SELECT split_part(symbol, ' ', 1) AS symbol, sum(unrealized_pnl)::DOUBLE AS unrealized_pnl,
 sum(market_value)::DOUBLE AS market_value, count(*) AS positions, sum(quantity)::DOUBLE AS quantity,
 sum(w * CASE WHEN asset_class <> 'OPT' THEN unit WHEN "right" = 'C' THEN strike + unit / 100 ELSE strike - unit / 100 END) AS wbe,
 sum(w) AS weight
FROM (SELECT *, abs(cost_basis)::DOUBLE / abs(quantity)::DOUBLE AS unit,
  abs(quantity)::DOUBLE * CASE WHEN asset_class = 'OPT' THEN 100 ELSE 1 END AS w FROM positions_latest) p GROUP BY 1) g"""


@query("unrealized_by_symbol", ("positions_latest",), _UNREALIZED, extra=DEDUP)
def unrealized_by_symbol(spark, sf):
    return show(H.unrealized_by_underlying(_latest(spark, sf)), breakeven=4)


@query("top_symbols_by_unrealized", ("positions_latest",),
       f"SELECT * FROM ({_UNREALIZED}) u ORDER BY unrealized_pnl DESC, symbol LIMIT 10", extra=DEDUP)
def top_symbols_by_unrealized(spark, sf):
    from folioforge.operators.trades import top_symbols

    return show(top_symbols(H.unrealized_by_underlying(_latest(spark, sf)), "unrealized_pnl"), breakeven=4)


@query("value_by_underlying", ("positions_latest",), """
SELECT account_id, CASE WHEN asset_class = 'OPT' THEN split_part(symbol, ' ', 1) ELSE symbol END AS underlying,
 sum(abs(market_value))::DOUBLE AS market_value FROM positions_latest GROUP BY 1, 2""", extra=DEDUP)
def value_by_underlying(spark, sf):
    return show(H.value_by_underlying(_latest(spark, sf)))


@query("portfolio_concentration", ("positions_latest",), """
SELECT account_id, round(hhi, 6) AS herfindahl, round(top, 6) AS top_holding_pct, n AS num_holdings,
 CASE WHEN hhi < 1500 THEN 'Diversified' WHEN hhi < 2500 THEN 'Moderate' ELSE 'Concentrated' END AS label
FROM (SELECT account_id, sum(share * share) AS hhi, max(share) AS top, count(*) AS n
 FROM (SELECT account_id, abs(market_value)::DOUBLE / sum(abs(market_value)) OVER (PARTITION BY account_id)::DOUBLE * 100 AS share
  FROM positions_latest WHERE asset_class IN ('STK', 'ETF')) s GROUP BY 1) g""", extra=DEDUP)
def portfolio_concentration(spark, sf):
    return show(H.concentration(_latest(spark, sf)), herfindahl=6, top_holding_pct=6)


@query("account_value_share", ("positions_latest",), """
SELECT account_id, symbol, market_value::DOUBLE AS market_value,
 round(abs(market_value)::DOUBLE / sum(abs(market_value)) OVER ()::DOUBLE * 100, 8) AS share_all
FROM positions_latest WHERE market_value IS NOT NULL""", extra=DEDUP)
def account_value_share(spark, sf):
    rows = _latest(spark, sf).where(F.col("market_value").isNotNull()).withColumn("unsigned", F.abs("market_value"))
    return show(share_of_total(rows, "unsigned", "share_all").select("account_id", "symbol", "market_value", "share_all"), share_all=8)


@query("underlying_names", ("positions_overlap",), """
SELECT asset_class, CASE WHEN asset_class = 'OPT' THEN split_part(symbol, ' ', 1) ELSE symbol END AS underlying,
 split_part(symbol, ' ', 1) AS first_token, CASE WHEN asset_class = 'OPT' THEN 100 ELSE 1 END::BIGINT AS multiplier,
 count(*) AS rows, sum(abs(cost_basis))::DOUBLE AS cost_value FROM positions_overlap GROUP BY 1, 2, 3, 4""")
def underlying_names(spark, sf):
    rows = H.valued(V.positions_overlap(spark, sf))
    return show(rows.groupBy("asset_class", underlying().alias("underlying"), first_token().alias("first_token"), "multiplier")
                .agg(F.count("*").alias("rows"), F.sum("cost_value").alias("cost_value")))


# --- reconciliation ---------------------------------------------------------------------------

RECON = {
    **DEDUP,
    "pairs": (["positions_overlap", "statements"], """
SELECT * FROM (SELECT account_id, statement_date AS base_date, lead(statement_date) OVER (PARTITION BY account_id ORDER BY statement_date) AS target_date
 FROM (SELECT DISTINCT account_id, statement_date FROM positions_overlap JOIN statements ON id = statement_id) d) x WHERE target_date IS NOT NULL"""),
    "unique_trades": (["trades_overlap", "statements"], """
SELECT * FROM (SELECT t.*, account_id, row_number() OVER (PARTITION BY account_id, trade_date, symbol, asset_class, side, quantity, price
 ORDER BY statement_id) AS rn FROM trades_overlap t JOIN statements s ON s.id = t.statement_id) u WHERE rn = 1"""),
    "moves": (["unique_trades", "pairs"], """
SELECT base_date, target_date, t.* FROM unique_trades t JOIN pairs p ON t.account_id = p.account_id
 AND trade_date > base_date AND trade_date <= target_date + INTERVAL 86399 SECOND"""),
    "recon": (["moves", "pairs", "positions_dedup"], """
SELECT *, reconstructed_qty - expected_qty AS diff, reconstructed_qty = expected_qty AS match,
 asset_class = 'OPT' AND expiry < target_date AND reconstructed_qty <= 0 AND expected_qty <= 0 AS suppressed,
 CASE WHEN NOT in_target AND reconstructed_qty > 0 THEN 'missing_from_target'
  WHEN in_target AND reconstructed_qty <= 0 AND expected_qty > 0 THEN 'missing_from_reconstruction' END AS gap
FROM (SELECT account_id, base_date, target_date, symbol, expiry, strike, "right", coalesce(r.asset_class, e.asset_class) AS asset_class,
  coalesce(base_qty, 0) AS base_qty, coalesce(n, 0) AS trades, coalesce(base_qty, 0) + coalesce(traded, 0) AS reconstructed_qty,
  coalesce(expected, 0) AS expected_qty, expected IS NOT NULL AS in_target
 FROM (SELECT account_id, base_date, target_date, symbol, expiry, strike, "right", min(asset_class) AS asset_class,
   sum(b) AS base_qty, sum(m) AS traded, sum(c) AS n FROM (
   SELECT p.account_id, p.base_date, p.target_date, symbol, CASE WHEN asset_class = 'OPT' THEN coalesce(expiry, DATE '0001-01-01') ELSE DATE '0001-01-01' END AS expiry,
    coalesce(strike, -1) AS strike, coalesce("right", '') AS "right", asset_class, quantity AS b, 0 AS m, 0 AS c
   FROM positions_dedup d JOIN pairs p ON p.account_id = d.account_id AND p.base_date = d.statement_date
   UNION ALL SELECT account_id, base_date, target_date, symbol, coalesce(expiry, DATE '0001-01-01'), coalesce(strike, -1), coalesce("right", ''),
    asset_class, 0, CASE WHEN side = 'BOT' THEN quantity ELSE -quantity END, 1 FROM moves) u GROUP BY ALL) r
 FULL JOIN (SELECT p.account_id, p.base_date, p.target_date, symbol, coalesce(expiry, DATE '0001-01-01') AS expiry,
   coalesce(strike, -1) AS strike, coalesce("right", '') AS "right", asset_class, quantity AS expected
  FROM positions_dedup d JOIN pairs p ON p.account_id = d.account_id AND p.target_date = d.statement_date) e
 USING (account_id, base_date, target_date, symbol, expiry, strike, "right")) x"""),
}


def _recon(spark, sf):
    return R.reconcile(V.trades_overlap(spark, sf), V.stored(V.positions_overlap, spark, sf), V.statements(spark, sf))


@query("snapshot_pairs", ("pairs",), "SELECT account_id, base_date, target_date FROM pairs", extra=RECON,
       days=("base_date", "target_date"))
def snapshot_pairs(spark, sf):
    return show(R.snapshot_pairs(V.positions_overlap(spark, sf), V.statements(spark, sf)))


_RECON_OUT = """account_id, base_date, target_date, symbol, asset_class, base_qty::DOUBLE AS base_qty,
 CAST(trades AS BIGINT) AS trades, reconstructed_qty::DOUBLE AS reconstructed_qty, expected_qty::DOUBLE AS expected_qty,
 diff::DOUBLE AS diff, match"""


@query("reconcile_all_pairs", ("recon",), f"""
SELECT {_RECON_OUT}, suppressed, gap FROM recon""", extra=RECON, days=("base_date", "target_date"))
def reconcile_all_pairs(spark, sf):
    return show(_recon(spark, sf).select(
        *R.PAIR, "symbol", "asset_class", "base_qty", "trades", "reconstructed_qty", "expected_qty", "diff", "match", "suppressed", "gap"))


@query("reconcile_mismatches", ("recon",), f"SELECT {_RECON_OUT} FROM recon WHERE NOT suppressed AND NOT match",
       extra=RECON, days=("base_date", "target_date"))
def reconcile_mismatches(spark, sf):
    return show(R.judged(_recon(spark, sf)).where(~F.col("match")).select(
        *R.PAIR, "symbol", "asset_class", "base_qty", "trades", "reconstructed_qty", "expected_qty", "diff", "match"))


@query("reconcile_summary", ("recon",), """
SELECT account_id, base_date, target_date, count(*) AS holdings, count(*) FILTER (WHERE NOT match) AS mismatches,
 count(*) FILTER (WHERE gap = 'missing_from_target') AS missing_from_target,
 count(*) FILTER (WHERE gap = 'missing_from_reconstruction') AS missing_from_reconstruction, bool_and(match) AS ok
FROM recon WHERE NOT suppressed GROUP BY 1, 2, 3""", extra=RECON, days=("base_date", "target_date"))
def reconcile_summary(spark, sf):
    return show(R.pair_summary(_recon(spark, sf)))


@query("recon_gaps", ("recon",), """
SELECT account_id, target_date, gap, symbol, reconstructed_qty::DOUBLE AS reconstructed_qty, expected_qty::DOUBLE AS expected_qty
FROM recon WHERE NOT suppressed AND gap IS NOT NULL""", extra=RECON, days=("target_date",))
def recon_gaps(spark, sf):
    return show(R.judged(_recon(spark, sf)).where(F.col("gap").isNotNull()).select(
        "account_id", "target_date", "gap", "symbol", "reconstructed_qty", "expected_qty"))


@query("reconcile_last_pair", ("recon",), """
SELECT account_id, base_date, target_date, count(*) FILTER (WHERE NOT match) AS mismatches
FROM recon WHERE NOT suppressed AND (account_id, target_date) IN (SELECT (account_id, max(target_date)) FROM pairs GROUP BY account_id)
GROUP BY 1, 2, 3""", extra=RECON, days=("base_date", "target_date"))
def reconcile_last_pair(spark, sf):
    positions, statements = V.stored(V.positions_overlap, spark, sf), V.statements(spark, sf)
    last = R.latest_pairs(R.snapshot_pairs(positions, statements))
    result = R.reconcile(V.trades_overlap(spark, sf), positions, statements, last)
    return show(R.pair_summary(result).select(*R.PAIR, "mismatches"))


@query("trade_ledger", ("moves", "positions_dedup"), """
SELECT m.account_id, m.base_date, m.target_date, m.symbol, strftime(trade_date, '%Y-%m-%d %H:%M:%S') AS trade_time, side,
 m.quantity::DOUBLE AS quantity, (coalesce(b.quantity, 0) + sum(CASE WHEN side = 'BOT' THEN m.quantity ELSE -m.quantity END) OVER (
  PARTITION BY m.account_id, m.base_date, m.symbol, m.expiry, m.strike, m."right"
  ORDER BY trade_date, side, m.quantity, price ROWS UNBOUNDED PRECEDING))::DOUBLE AS running_qty
FROM moves m LEFT JOIN positions_dedup b ON b.account_id = m.account_id AND b.statement_date = m.base_date AND b.symbol = m.symbol
 AND b.expiry IS NOT DISTINCT FROM m.expiry AND b.strike IS NOT DISTINCT FROM m.strike AND b."right" IS NOT DISTINCT FROM m."right" """,
       extra=RECON, days=("base_date", "target_date"))
def trade_ledger(spark, sf):
    base = V.stored(V.trades_base, spark, sf)
    rows = R.ledger(V.trades_overlap(spark, sf, base), V.stored(V.positions_overlap, spark, sf, base), V.statements(spark, sf))
    return show(rows.select(
        *R.PAIR, "symbol", F.date_format("trade_date", "yyyy-MM-dd HH:mm:ss").alias("trade_time"), "side", "quantity", "running_qty"))


# --- daily bars -------------------------------------------------------------------------------


@query("prices_in_range", ("daily_prices",), """
SELECT symbol, price_date, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close,
 adj_close::DOUBLE AS adj_close, volume FROM daily_prices
WHERE price_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'""", days=("price_date",))
def prices_in_range(spark, sf):
    return show(P.price_range(V.daily_prices(spark, sf), date(1998, 1, 1), date(1998, 6, 30)))


@query("latest_price", ("daily_prices",), """
SELECT symbol, max(price_date) AS price_date, arg_max(open, price_date)::DOUBLE AS open, arg_max(high, price_date)::DOUBLE AS high,
 arg_max(low, price_date)::DOUBLE AS low, arg_max(close, price_date)::DOUBLE AS close, arg_max(adj_close, price_date)::DOUBLE AS adj_close,
 arg_max(volume, price_date) AS volume FROM daily_prices GROUP BY 1""", days=("price_date",))
def latest_price(spark, sf):
    return show(P.latest_prices(V.daily_prices(spark, sf)))


@query("price_coverage", ("daily_prices",), """
SELECT symbol, min(price_date) AS first_date, max(price_date) AS last_date, count(*) AS days FROM daily_prices GROUP BY 1""",
       days=("first_date", "last_date"))
def price_coverage(spark, sf):
    return show(P.coverage(V.daily_prices(spark, sf)))


@query("price_gaps", ("daily_prices",), """
SELECT symbol, gap_start, gap_end FROM (
 SELECT r.symbol, unnest(CASE WHEN mn IS NULL THEN [(s, e)] ELSE [(s, CAST(mn - 1 AS DATE)), (CAST(mx + 1 AS DATE), e)] END) AS g,
  g[1] AS gap_start, g[2] AS gap_end
 FROM (SELECT DISTINCT p_brand AS symbol, DATE '1994-06-01' AS s, DATE '2002-03-31' AS e FROM part
  UNION ALL SELECT 'NONE', DATE '1994-06-01', DATE '2002-03-31') r
 LEFT JOIN (SELECT symbol, min(price_date) AS mn, max(price_date) AS mx FROM daily_prices GROUP BY 1) c ON c.symbol = r.symbol) x
WHERE gap_start <= gap_end""", days=("gap_start", "gap_end"))
def price_gaps(spark, sf):
    names = V.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    names = names.unionByName(spark.createDataFrame([("NONE",)], "symbol string"))
    requests = names.select("symbol", F.lit(date(1994, 6, 1)).alias("start"), F.lit(date(2002, 3, 31)).alias("end"))
    return show(P.missing_ranges(requests, V.daily_prices(spark, sf)))


@query("data_freshness", ("daily_prices",), """
SELECT symbol, last_date, age_days, CASE WHEN age_days IS NULL THEN 'none' WHEN age_days <= 1 THEN 'fresh'
 WHEN age_days <= 7 THEN 'aging' ELSE 'stale' END AS band
FROM (SELECT s.symbol, last_date, date_diff('day', last_date, DATE '2001-11-05') AS age_days
 FROM (SELECT DISTINCT p_brand AS symbol FROM part UNION ALL SELECT 'NONE') s
 LEFT JOIN (SELECT symbol, max(price_date) AS last_date FROM daily_prices GROUP BY 1) c ON c.symbol = s.symbol) x""",
       days=("last_date",))
def data_freshness(spark, sf):
    names = V.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    names = names.unionByName(spark.createDataFrame([("NONE",)], "symbol string"))
    return show(P.freshness(names, V.daily_prices(spark, sf), date(2001, 11, 5)))


@query("symbols_without_prices", ("daily_prices", "positions_overlap"), """
SELECT DISTINCT split_part(symbol, ' ', 1) || CASE WHEN asset_class = 'ETF' THEN '.X' ELSE '' END AS symbol FROM positions_overlap
WHERE split_part(symbol, ' ', 1) || CASE WHEN asset_class = 'ETF' THEN '.X' ELSE '' END NOT IN (SELECT symbol FROM daily_prices)""")
def symbols_without_prices(spark, sf):
    wanted = V.positions_overlap(spark, sf).select(
        F.concat(first_token(), F.when(F.col("asset_class") == "ETF", ".X").otherwise("")).alias("symbol"))
    return P.without_prices(wanted, V.daily_prices(spark, sf))


# --- keyed writes -----------------------------------------------------------------------------

PRICE_LOADS = {
    # A stored table that lacks the newest year, and a load that revises 2000 and brings 2001 twice.
    "stored_prices": (["daily_prices"], "SELECT * FROM daily_prices WHERE price_date < DATE '2001-01-01'"),
    "loaded_prices": (["daily_prices"], """
SELECT symbol, price_date, open, high, low, CAST(close + 1 AS DECIMAL(18,4)) AS close, adj_close, volume, 1 AS load_no
FROM daily_prices WHERE price_date >= DATE '2000-01-01'
UNION ALL SELECT symbol, price_date, open, high, low, CAST(close + 2 AS DECIMAL(18,4)), adj_close, volume, 2
FROM daily_prices WHERE price_date >= DATE '2001-01-01'"""),
}


def _price_loads(spark, sf):
    prices = V.stored(V.daily_prices, spark, sf)
    stored = prices.where(F.col("price_date") < F.lit(date(2001, 1, 1)))
    copies = F.array(*[
        F.when(F.col("price_date") >= F.lit(d), F.lit(n)) for n, d in ((1, date(2000, 1, 1)), (2, date(2001, 1, 1)))
    ])
    loaded = (
        prices.where(F.col("price_date") >= F.lit(date(2000, 1, 1)))
        .withColumn("load_no", F.explode(F.filter(copies, lambda x: x.isNotNull())))
        .withColumn("close", (F.col("close") + F.col("load_no")).cast("decimal(18,4)"))
    )
    return stored, loaded


@query("upsert_prices", ("stored_prices", "loaded_prices"), """
SELECT symbol, price_date, close::DOUBLE AS close, volume FROM stored_prices s
WHERE NOT EXISTS (SELECT 1 FROM loaded_prices l WHERE l.symbol = s.symbol AND l.price_date = s.price_date)
UNION ALL SELECT symbol, price_date, arg_max(close, load_no)::DOUBLE, arg_max(volume, load_no) FROM loaded_prices GROUP BY 1, 2""",
       extra=PRICE_LOADS, days=("price_date",))
def upsert_prices(spark, sf):
    stored, loaded = _price_loads(spark, sf)
    out = K.upsert(stored.withColumn("load_no", F.lit(0)), loaded, ["symbol", "price_date"], [F.col("load_no").desc()])
    return show(out.select("symbol", "price_date", "close", "volume"))


@query("upsert_price_counts", ("stored_prices", "loaded_prices"), """
SELECT count(*) FILTER (WHERE s.symbol IS NULL) AS inserted, count(*) FILTER (WHERE s.symbol IS NOT NULL) AS updated
FROM (SELECT DISTINCT symbol, price_date FROM loaded_prices) l
LEFT JOIN stored_prices s ON s.symbol = l.symbol AND s.price_date = l.price_date""", extra=PRICE_LOADS)
def upsert_price_counts(spark, sf):
    stored, loaded = _price_loads(spark, sf)
    return K.upsert_counts(stored, loaded, ["symbol", "price_date"])
