"""Queries on betas, option greeks and beta exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import instruments as I
from folioforge.functions.numeric import _HART_DENOMINATOR, _HART_NUMERATOR
from folioforge.operators import beta as B
from folioforge.operators import holdings as H
from folioforge.operators import prices as P
from folioforge.operators.lineage import written_once
from folioforge.plans import views as V
from folioforge.plans.holding_queries import DEDUP, _latest
from folioforge.plans.registry import query, show

# The test year ends with thin trading, so the recency windows are wider than the defaults.
WINDOWS = {"price_days": 90, "vol_days": 400}


def _horner_sql(coefficients: list[float], x: str) -> str:
    text = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


_NEAR = f"(exp(-a * a / 2) * {_horner_sql(_HART_NUMERATOR, 'a')} / {_horner_sql(_HART_DENOMINATOR, 'a')})"
_FAR = "(exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65::DOUBLE))))) / 2.506628274631::DOUBLE)"
_UPPER = f"CASE WHEN a > 37 THEN 0 WHEN a < 7.07106781186547 THEN {_NEAR} ELSE {_FAR} END"

BETA = {
    **DEDUP,
    "beta_rows": (["daily_prices"], """
SELECT symbol, benchmark, price_date, ln(s / lag(s) OVER w) AS rs, ln(b / lag(b) OVER w) AS rb
FROM (SELECT p.symbol, q.symbol AS benchmark, p.price_date, p.adj_close::DOUBLE AS s, q.adj_close::DOUBLE AS b,
  row_number() OVER (PARTITION BY p.symbol, q.symbol ORDER BY p.price_date DESC) AS back
 FROM daily_prices p JOIN daily_prices q ON p.price_date = q.price_date AND q.symbol IN ('MKT', 'STD')
 WHERE p.symbol LIKE 'Brand%' AND p.price_date >= DATE '2001-12-31' - 400 AND p.price_date <= DATE '2001-12-31') j
WHERE back <= 252 WINDOW w AS (PARTITION BY symbol, benchmark ORDER BY price_date)"""),
    "betas": (["beta_rows", "daily_prices"], """
SELECT symbol, benchmark, count(price_date) AS rows,
 CASE WHEN count(price_date) >= 60 AND count(rs) >= 59 THEN regr_slope(rs, rb) END AS beta
FROM (SELECT DISTINCT symbol FROM daily_prices WHERE symbol LIKE 'Brand%' AND price_date BETWEEN DATE '2001-12-31' - 400 AND DATE '2001-12-31') s
CROSS JOIN (SELECT unnest(['MKT', 'STD']) AS benchmark) b LEFT JOIN beta_rows USING (symbol, benchmark) GROUP BY 1, 2"""),
    "spots": (["positions_latest", "daily_prices"], """
SELECT account_id, underlying, CASE WHEN hp > 0 THEN hp::DOUBLE WHEN lc > 0 THEN lc::DOUBLE END AS spot
FROM (SELECT account_id, CASE WHEN asset_class = 'OPT' THEN split_part(symbol, ' ', 1) ELSE symbol END AS underlying,
 max(CASE WHEN asset_class <> 'OPT' THEN market_price END) AS hp FROM positions_latest GROUP BY 1, 2) h
LEFT JOIN (SELECT symbol, arg_max(close, price_date) AS lc FROM daily_prices
 WHERE price_date BETWEEN DATE '2001-12-31' - 90 AND DATE '2001-12-31' GROUP BY 1) c ON c.symbol = underlying"""),
    "vols": (["daily_prices"], """
SELECT symbol, CASE WHEN count(*) >= 21 THEN stddev_samp(r) FILTER (WHERE back <= 20) * sqrt(252) END AS vol
FROM (SELECT symbol, ln(adj_close::DOUBLE / lag(adj_close::DOUBLE) OVER (PARTITION BY symbol ORDER BY price_date)) AS r,
 row_number() OVER (PARTITION BY symbol ORDER BY price_date DESC) AS back FROM daily_prices
 WHERE price_date BETWEEN DATE '2001-12-31' - 400 AND DATE '2001-12-31') x GROUP BY 1"""),
    "greeks": (["positions_latest", "spots", "vols", "betas"], f"""
SELECT *, CASE WHEN option_price > 0 THEN underlying_beta * delta * spot / option_price END AS option_beta
FROM (SELECT z.*, b.benchmark, b.beta AS underlying_beta, CASE WHEN z.ok THEN CASE WHEN z."right" = 'C' THEN nx ELSE nx - 1 END END AS delta
FROM (SELECT y.*, CASE WHEN d1 > 0 THEN 1 - ({_UPPER}) ELSE {_UPPER} END AS nx
FROM (SELECT x.*, abs(d1) AS a FROM (
SELECT p.*, split_part(p.symbol, ' ', 1) AS underlying, spot, coalesce(CASE WHEN vol > 0 THEN vol END, 0.3)::DOUBLE AS sigma,
 greatest(date_diff('day', DATE '2001-12-31', expiry), 0) / 365::DOUBLE AS years, abs(market_price)::DOUBLE AS option_price,
 spot > 0 AND strike > 0 AND years > 0 AS ok,
 CASE WHEN spot > 0 AND strike > 0 AND years > 0 THEN
  (ln(spot / strike::DOUBLE) + (0.045::DOUBLE + sigma * sigma * 0.5::DOUBLE) * years) / (sigma * sqrt(years)) END AS d1
FROM positions_latest p LEFT JOIN spots s ON s.account_id = p.account_id AND s.underlying = split_part(p.symbol, ' ', 1)
LEFT JOIN vols v ON v.symbol = split_part(p.symbol, ' ', 1) WHERE p.asset_class = 'OPT') x) y) z
LEFT JOIN betas b ON b.symbol = z.underlying) g"""),
    "effective": (["greeks", "positions_latest", "betas"], """
SELECT account_id, p.symbol, asset_class, benchmark, beta AS effective_beta, abs(market_value)::DOUBLE AS weight_value
FROM positions_latest p JOIN betas b ON b.symbol = p.symbol WHERE asset_class <> 'OPT'
UNION ALL SELECT account_id, symbol, asset_class, benchmark, option_beta, market_value::DOUBLE FROM greeks WHERE benchmark IS NOT NULL"""),
}


def _betas(spark, sf, prices=None):
    prices = P.lookback(V.stored(V.daily_prices, spark, sf) if prices is None else prices, V.AS_OF, 400)
    return B.betas(prices.where(F.col("symbol").startswith("Brand")), prices.where(F.col("symbol").isin(V.BENCHMARKS)))


@query("beta_by_symbol", ("betas",), "SELECT symbol, benchmark, rows, round(beta, 8) AS beta FROM betas", extra=BETA)
def beta_by_symbol(spark, sf):
    return show(_betas(spark, sf), beta=8)


@query("portfolio_beta", ("betas", "positions_latest"), """
SELECT account_id, benchmark, round(CASE WHEN sum(mv) FILTER (WHERE beta IS NOT NULL) > 0 THEN
  sum(beta * mv) / sum(mv) FILTER (WHERE beta IS NOT NULL) END, 8) AS portfolio_beta,
 round(coalesce(sum(beta * mv), 0), 2) AS portfolio_dollar_beta,
 count(beta) AS with_beta, count(*) - count(beta) AS without_beta
FROM (SELECT account_id, CASE WHEN asset_class = 'OPT' THEN split_part(symbol, ' ', 1) ELSE symbol END AS underlying,
 sum(abs(market_value))::DOUBLE AS mv FROM positions_latest GROUP BY 1, 2) v LEFT JOIN betas b ON b.symbol = v.underlying
GROUP BY 1, 2""", extra=BETA)
def portfolio_beta(spark, sf):
    exposure = B.dollar_betas(H.value_by_underlying(_latest(spark, sf)), _betas(spark, sf), V.BENCHMARKS)
    return show(B.portfolio_beta(exposure), portfolio_beta=8, portfolio_dollar_beta=2)


@query("beta_with_overrides", ("betas",), """
SELECT symbol, benchmark, round(coalesce(beta, m), 8) AS beta FROM (
 SELECT symbol, benchmark, CASE WHEN rows >= 200 THEN beta END AS beta, 1.25 AS m FROM betas) b""", extra=BETA)
def beta_with_overrides(spark, sf):
    computed = _betas(spark, sf).withColumn("beta", F.when(F.col("rows") >= 200, F.col("beta")))
    manual = V.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("manual_beta", F.lit(1.25))
    return show(B.override_missing(computed, manual).drop("rows"), beta=8)


def _inputs(spark, sf):
    """Latest positions, bars and betas; each is read several times below, so each is written once."""
    prices = V.stored(V.daily_prices, spark, sf)
    return written_once(_latest(spark, sf)), prices, written_once(_betas(spark, sf, prices)), V.BENCHMARKS, V.AS_OF


def _greeks(spark, sf):
    return B.option_greeks(*_inputs(spark, sf), **WINDOWS)


@query("option_greeks", ("greeks",), """
SELECT account_id, symbol, benchmark, spot, round(sigma, 8) AS sigma, round(years, 8) AS years, round(delta, 8) AS delta,
 round(option_beta, 6) AS option_beta FROM greeks""", extra=BETA)
def option_greeks(spark, sf):
    return show(_greeks(spark, sf).select("account_id", "symbol", "benchmark", "spot", "sigma", "years", "delta", "option_beta"),
                sigma=8, years=8, delta=8, option_beta=6)


@query("position_dollar_beta", ("effective",), """
SELECT account_id, symbol, benchmark, round(effective_beta, 6) AS effective_beta,
 round(CASE WHEN weight_value <> 0 THEN effective_beta * weight_value END, 1) AS dollar_beta FROM effective""", extra=BETA)
def position_dollar_beta(spark, sf):
    rows = B.effective_betas(*_inputs(spark, sf), **WINDOWS)
    return show(rows.select("account_id", "symbol", "benchmark", "effective_beta", "dollar_beta"), effective_beta=6, dollar_beta=1)


@query("option_adjusted_beta", ("effective",), """
SELECT account_id, benchmark, round(sum(effective_beta * weight_value) / sum(abs(weight_value)) FILTER (WHERE effective_beta IS NOT NULL), 8) AS portfolio_beta,
 round(coalesce(sum(effective_beta * weight_value), 0), 1) AS portfolio_dollar_beta FROM effective GROUP BY 1, 2""", extra=BETA)
def option_adjusted_beta(spark, sf):
    rows = B.effective_betas(*_inputs(spark, sf), **WINDOWS)
    return show(B.option_adjusted_beta(rows), portfolio_beta=8, portfolio_dollar_beta=1)


@query("option_terms", ("positions_latest", "daily_prices"), """
SELECT account_id, symbol, date_diff('day', DATE '2001-12-31', expiry) AS dte, round(m, 8) AS moneyness,
 CASE WHEN m > 0.01 THEN 'ITM' WHEN m < -0.01 THEN 'OTM' WHEN m IS NULL THEN 'N/A' ELSE 'ATM' END AS label,
 breakeven FROM (SELECT account_id, p.symbol, expiry,
  CASE WHEN "right" = 'C' THEN (c - strike::DOUBLE) / strike::DOUBLE ELSE (strike::DOUBLE - c) / strike::DOUBLE END AS m,
  CASE WHEN "right" = 'C' THEN strike::DOUBLE + (cost_basis::DOUBLE / 100) / quantity::DOUBLE
   ELSE strike::DOUBLE - (cost_basis::DOUBLE / 100) / quantity::DOUBLE END AS breakeven
 FROM positions_latest p LEFT JOIN (SELECT symbol, arg_max(close, price_date)::DOUBLE AS c FROM daily_prices GROUP BY 1) l
  ON l.symbol = split_part(p.symbol, ' ', 1) WHERE asset_class = 'OPT') x""", extra=BETA)
def option_terms(spark, sf):
    options = _latest(spark, sf).where(I.is_option()).withColumn("underlying", I.underlying())
    last = P.latest_prices(V.daily_prices(spark, sf)).select(F.col("symbol").alias("underlying"), "close")
    value = I.moneyness(F.col("strike"), F.col("close"), F.col("right"))
    return show(options.join(last, "underlying", "left").select(
        "account_id", "symbol", I.days_to_expiry("expiry", V.AS_OF).alias("dte"), value.alias("moneyness"),
        I.moneyness_label(value).alias("label"),
        I.breakeven(F.col("strike"), F.col("cost_basis"), F.col("quantity"), F.col("right")).alias("breakeven"),
    ), moneyness=8)
