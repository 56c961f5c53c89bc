"""The same views as SQL common table expressions, for the independent engine."""

from __future__ import annotations

from folioforge.plans.views import INV_RULE, METRIC_RULES, REVERSE_RULE, SHARES_RULE

_UNITS = "(2 * {c} * 100 + {q}) // (2 * {q})"
_FLOWS = ["revenue", "net_income", "operating_income", "gross_profit", "eps_basic", "eps_diluted",
          "capital_expenditures", "dividends_paid", "interest_expense"]


def _dec(units: str) -> str:
    return f"CAST(CAST({units} AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4))"


_metric_union = "\nUNION ALL\n".join(
    f"""SELECT n, y, fp, period_end, period_start, '{name}' AS metric_name,
 CAST({rule} AS DECIMAL(28,6)) AS metric_value, {'TRUE' if name in _FLOWS else 'FALSE'} AS is_flow FROM period_rows"""
    for name, rule in METRIC_RULES.items()
)

# name -> (dependencies, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "ship_years": ([], """
SELECT unnest(generate_series(lo, hi)) AS y FROM (SELECT min(year(l_shipdate)) AS lo, max(year(l_shipdate)) AS hi FROM lineitem) b"""),
    "line_parts": ([], """
SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, CAST(l_quantity AS BIGINT) AS qty,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_discount AS DECIMAL(4,2)) AS discount,
 CAST(l_tax AS DECIMAL(4,2)) AS tax, p_partkey, p_brand, p_type, p_size,
 CAST(p_retailprice AS DECIMAL(18,4)) AS retail, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS brand_no
FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "trades_base": (["line_parts"], f"""
SELECT account_id || '-' || year(l_shipdate) AS statement_id,
 l_shipdate + to_hours(l_linenumber - 1) AS trade_date,
 CASE WHEN opt THEN p_brand || ' ' || upper(strftime(expiry0, '%d%b%y')) || ' '
   || CAST(CAST(retail AS DECIMAL(18,2)) AS VARCHAR) || ' ' || right0 ELSE p_brand END AS symbol,
 CASE WHEN opt THEN 'OPT' WHEN brand_no % 5 = 0 THEN 'ETF' ELSE 'STK' END AS asset_class,
 CASE WHEN sold THEN 'SLD' ELSE 'BOT' END AS side,
 CAST(qty AS DECIMAL(18,4)) AS quantity,
 {_dec(_UNITS.format(c='cents', q='qty'))} AS price,
 CAST(CASE WHEN sold THEN ext ELSE -ext END AS DECIMAL(18,4)) AS proceeds,
 CAST(-(ext * tax) * 0.01 AS DECIMAL(18,6)) AS commission,
 CASE WHEN sold THEN CAST(ext * (discount - 0.05) AS DECIMAL(18,4)) ELSE CAST(0 AS DECIMAL(18,4)) END AS realized_pnl,
 'USD' AS currency,
 CASE WHEN opt THEN expiry0 END AS expiry, CASE WHEN opt THEN retail END AS strike,
 CASE WHEN opt THEN right0 END AS "right",
 account_id, p_brand, CASE WHEN opt THEN p_partkey ELSE brand_no END AS symbol_no, l_orderkey
FROM (SELECT lp.*, 'U' || CAST(o_custkey % 10 AS VARCHAR) AS account_id, p_type = 'PROMO' AS opt,
   l_returnflag = 'R' AS sold, CAST(DATE '1996-01-01' + p_size * 60 AS DATE) AS expiry0,
   CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS right0,
   CAST(CAST(cents AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS ext
  FROM line_parts lp JOIN orders ON l_orderkey = o_orderkey) t"""),
    "trades": (["trades_base"], """
SELECT statement_id, trade_date, symbol, asset_class, side, quantity, price, proceeds, commission,
 realized_pnl, currency, expiry, strike, "right" FROM trades_base"""),
    "trades_overlap": (["trades_base"], """
SELECT statement_id, trade_date, symbol, asset_class, side, quantity, price, proceeds, commission,
 realized_pnl, currency, expiry, strike, "right" FROM trades_base
UNION ALL
SELECT account_id || '-overlap', trade_date, symbol, asset_class, side, quantity, price, proceeds, commission,
 realized_pnl, currency, expiry, strike, "right" FROM trades_base WHERE l_orderkey % 20 = 0"""),
    "statements": (["ship_years"], """
SELECT account_id || '-' || y AS id, account_id, make_date(y, 1, 1) AS period_start,
 make_date(y, 12, 31) AS period_end, 'USD' AS base_currency, CAST(make_date(y, 12, 31) + 5 AS DATE) AS created_at
FROM (SELECT DISTINCT 'U' || CAST(o_custkey % 10 AS VARCHAR) AS account_id FROM orders) a,
 ship_years
UNION ALL
SELECT account_id || '-overlap', account_id, DATE '1995-01-01', DATE '2000-06-30', 'USD', DATE '2001-02-01'
FROM (SELECT DISTINCT 'U' || CAST(o_custkey % 10 AS VARCHAR) AS account_id FROM orders) a"""),
    "bar_sources": (["line_parts"], """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS price_date, cents, qty FROM line_parts
UNION ALL SELECT 'MKT', CAST(l_shipdate AS DATE), cents, qty FROM line_parts
UNION ALL SELECT 'STD', CAST(l_shipdate AS DATE), cents, qty FROM line_parts WHERE p_type = 'STANDARD'"""),
    "bars": (["bar_sources"], f"""
SELECT symbol, price_date, {_dec('max(' + _UNITS.format(c='cents', q='qty') + ')')} AS high,
 {_dec('min(' + _UNITS.format(c='cents', q='qty') + ')')} AS low,
 {_dec(_UNITS.format(c='CAST(sum(cents) AS BIGINT)', q='CAST(sum(qty) AS BIGINT)'))} AS close,
 CAST(sum(qty) AS BIGINT) AS volume
FROM bar_sources GROUP BY symbol, price_date"""),
    "daily_prices": (["bars"], """
SELECT symbol, price_date, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY price_date), close) AS open,
 high, low, close, close AS adj_close, volume FROM bars"""),
    "positions_base": (["trades_base", "ship_years"], f"""
SELECT *, CAST(market_value - cost_basis AS DECIMAL(18,4)) AS unrealized_pnl, 'USD' AS currency FROM (
SELECT *, CAST(quantity * market_price * CASE WHEN asset_class = 'OPT' THEN 100 ELSE 1 END AS DECIMAL(18,4)) AS market_value
FROM (SELECT account_id, symbol, asset_class, expiry, strike, "right", symbol_no, y,
  make_date(y, 12, 31) AS statement_date, CAST(make_date(y, 12, 31) + 5 AS DATE) AS created_at,
  account_id || '-' || y AS statement_id,
  CAST(net + CASE WHEN (symbol_no + 31 * y + 7 * CAST(substr(account_id, 2) AS INT)) % 13 = 0 THEN 5 ELSE 0 END
   AS DECIMAL(18,4)) AS quantity, CAST(cost AS DECIMAL(18,4)) AS cost_basis,
  CAST(CAST({_UNITS.format(c='cents', q='volume')} AS DECIMAL(18,0)) * CASE WHEN asset_class = 'OPT' THEN 0.000005 ELSE 0.000100 END
   AS DECIMAL(18,4)) AS market_price
 FROM (SELECT account_id, symbol, asset_class, expiry, strike, "right", symbol_no, y,
   sum(CASE WHEN side = 'BOT' THEN quantity ELSE -quantity END) AS net,
   sum(CASE WHEN side = 'BOT' THEN -proceeds ELSE 0 END) AS cost,
   CAST(sum(abs(proceeds)) * 100 AS BIGINT) AS cents, CAST(sum(quantity) AS BIGINT) AS volume
  FROM trades_base JOIN ship_years ON year(trade_date) <= y
  GROUP BY ALL) g WHERE net <> 0) s
 WHERE quantity <> 0) b"""),
    "positions": (["positions_base"], """
SELECT statement_id, symbol, asset_class, quantity, cost_basis, market_price, market_value, unrealized_pnl,
 currency, statement_date, expiry, strike, "right" FROM positions_base"""),
    "positions_overlap": (["positions_base", "ship_years"], """
SELECT statement_id, symbol, asset_class, quantity, cost_basis, market_price, market_value, unrealized_pnl,
 currency, statement_date, expiry, strike, "right" FROM positions_base
UNION ALL
SELECT account_id || '-overlap', symbol, asset_class, CAST(quantity + 1 AS DECIMAL(18,4)), cost_basis,
 market_price, market_value, unrealized_pnl, currency, statement_date, expiry, strike, "right"
FROM positions_base WHERE symbol_no % 10 = 3 AND y IN (SELECT max(y) - k FROM ship_years CROSS JOIN (VALUES (0), (2)) t(k) GROUP BY k)"""),
    "quarter_totals": ([], """
SELECT c_nationkey AS n, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS qrev,
 CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) * 0.3 ELSE 0 END) AS DECIMAL(20,3)) AS qni
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""),
    "period_rows": (["quarter_totals"], f"""
SELECT *, CASE WHEN {REVERSE_RULE} THEN ({SHARES_RULE}) // 10 ELSE {SHARES_RULE} END AS shares,
 CAST(({INV_RULE}) * CASE WHEN {REVERSE_RULE} THEN 10 ELSE 1 END AS DECIMAL(12,9)) AS inv_shares
FROM (SELECT n, y, CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || q END AS fp,
  CASE WHEN n % 2 = 0 OR q = 4 THEN ytd_rev ELSE qrev END AS rev,
  CASE WHEN n % 2 = 0 OR q = 4 THEN ytd_ni ELSE qni END AS ni, cum,
  last_day(make_date(y, 3 * q, 1)) AS period_end,
  CASE WHEN n % 2 = 0 OR q = 4 THEN make_date(y, 1, 1) ELSE make_date(y, 3 * q - 2, 1) END AS period_start
 FROM (SELECT *, CAST(sum(qrev) OVER (PARTITION BY n, y ORDER BY q) AS DECIMAL(20,2)) AS ytd_rev,
   CAST(sum(qni) OVER (PARTITION BY n, y ORDER BY q) AS DECIMAL(20,3)) AS ytd_ni,
   CAST(sum(qrev) OVER (PARTITION BY n ORDER BY y, q) AS DECIMAL(20,2)) AS cum FROM quarter_totals) w
) r WHERE n <> 24 OR fp = 'FY'"""),
    "stock_metrics": (["period_rows"], f"""
SELECT 'Brand#' || (n + 1) AS symbol, metric_name, metric_value, period_end,
 CASE WHEN is_flow THEN period_start END AS period_start, fp AS fiscal_period, y AS fiscal_year,
 CASE WHEN is_flow THEN date_diff('day', period_start, period_end) END AS duration_days,
 CASE WHEN n = 24 THEN 'annual_only' WHEN n IN (22, 23) THEN NULL WHEN n % 2 = 0 THEN 'cumulative_ytd'
  ELSE 'standalone_quarterly' END AS reporting_style, 'SEC_EDGAR' AS source,
 lpad(CAST(n + 1 AS VARCHAR), 10, '0') AS cik, CASE WHEN fp = 'FY' THEN '10-K' ELSE '10-Q' END AS filing_type,
 CAST(period_end + 40 AS DATE) AS fetched_at
FROM ({_metric_union}) m WHERE metric_value IS NOT NULL"""),
}


def compose(sql: str, *needed: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """Prefix ``sql`` with the named views and everything they depend on."""
    registry = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in registry[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needed:
        visit(name)
    if not ordered:
        return sql
    # Each view is computed once, however often it is used.
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({registry[n][1].strip()})" for n in ordered)
    return f"WITH {ctes}\n{sql.strip()}"
