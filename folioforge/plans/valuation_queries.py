"""Queries on ratios, growth, ratio history, scores and portfolio statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from folioforge.operators import keyed as K
from folioforge.operators import valuation as X
from folioforge.operators.lineage import written_once
from folioforge.operators.prices import latest_prices
from folioforge.plans import views as V
from folioforge.plans.fundamental_queries import _FLOW_LIST, _PREF, FUND
from folioforge.plans.holding_queries import DEDUP, _latest
from folioforge.plans.oracle_views import VIEWS
from folioforge.plans.registry import query, show
from folioforge.schemas import FLOW_METRICS, POINT_METRICS, SNAPSHOT_MEASURES, VALUATION_PRESETS

RATIO_DIGITS = {
    "market_cap": 1, "enterprise_value": 1, "pe_ttm": 6, "pb": 6, "ps": 6, "ev_ebitda": 6, "ev_revenue": 6,
    "earnings_yield": 9, "fcf_yield": 9, "gross_margin": 9, "operating_margin": 9, "net_margin": 9, "roe": 9, "roa": 9,
    "debt_to_equity": 9, "current_ratio": 9, "interest_coverage": 6, "cash_to_assets": 9, "dividend_yield": 9, "payout_ratio": 9,
}


def _rounded(digits: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in digits.items())


def _filter(metric: str) -> str:
    return f"max(v) FILTER (WHERE metric_name = '{metric}') AS {metric}"


def _logistic(c: str, up: bool) -> str:
    core = f"50 + 50 * (2 / (1 + exp(-8 * {c})) - 1)" if up else f"100 - 50 * (2 / (1 + exp(-1.5::DOUBLE * {c})) - 1)"
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(0, least(100, {core})) END"


_CATEGORY = ", ".join(
    "list_avg([" + ", ".join(
        (f"CASE WHEN {r}_pctl IS NOT NULL THEN greatest(0, least(100, 100 - {r}_pctl)) END" if cat == "valuation" else _logistic(r, up)) for r, up in members.items()
    ) + f"]) AS score_{cat}"
    for cat, members in X.SCORED_RATIOS.items()
)
_PRESETS = ", ".join(f"('{p}', {w['valuation']}, {w['profitability']}, {w['health']}, {w['growth']})" for p, w in X.SCORE_PRESETS.items())

VAL = {
    **DEDUP,
    **FUND,
    "inputs": (["latest", "norm_ttm_latest", "daily_prices"], f"""
SELECT symbol, price, {', '.join(_filter(m) for m in FLOW_METRICS + POINT_METRICS)} FROM (
 SELECT l.symbol, l.metric_name, CASE WHEN l.metric_name IN ({_FLOW_LIST}) AND fiscal_period <> 'FY'
   THEN coalesce(ttm_value, metric_value::DOUBLE) ELSE metric_value::DOUBLE END AS v
 FROM latest l LEFT JOIN norm_ttm_latest t ON t.symbol = l.symbol AND t.metric_name = l.metric_name) m
JOIN (SELECT symbol, arg_max(adj_close, price_date)::DOUBLE AS price FROM daily_prices GROUP BY 1) p USING (symbol) GROUP BY 1, 2"""),
    "ratios": (["inputs"], """
SELECT *, CASE WHEN eps > 0 THEN price / eps END AS pe_ttm, CASE WHEN stockholders_equity > 0 THEN market_cap / stockholders_equity END AS pb,
 CASE WHEN revenue > 0 THEN market_cap / revenue END AS ps, CASE WHEN operating_income > 0 THEN enterprise_value / operating_income END AS ev_ebitda,
 CASE WHEN revenue > 0 THEN enterprise_value / revenue END AS ev_revenue, net_income / nullif(market_cap, 0) AS earnings_yield,
 (operating_income - abs(capital_expenditures)) / nullif(market_cap, 0) AS fcf_yield, gross_profit / nullif(revenue, 0) AS gross_margin,
 operating_income / nullif(revenue, 0) AS operating_margin, net_income / nullif(revenue, 0) AS net_margin,
 net_income / nullif(stockholders_equity, 0) AS roe, net_income / nullif(total_assets, 0) AS roa,
 total_liabilities / nullif(stockholders_equity, 0) AS debt_to_equity, current_assets / nullif(current_liabilities, 0) AS current_ratio,
 operating_income / nullif(abs(interest_expense), 0) AS interest_coverage, cash_and_equivalents / nullif(total_assets, 0) AS cash_to_assets,
 abs(nullif(dividends_paid, 0)) / nullif(shares_outstanding, 0) / price AS dividend_yield,
 CASE WHEN net_income > 0 THEN abs(nullif(dividends_paid, 0)) / net_income END AS payout_ratio
FROM (SELECT *, market_cap + total_liabilities - cash_and_equivalents AS enterprise_value FROM (
 SELECT *, coalesce(nullif(eps_diluted, 0), eps_basic) AS eps, price * nullif(shares_outstanding, 0) AS market_cap FROM inputs) a) b"""),
    "annual": (["stock_metrics"], """
SELECT symbol, metric_name, period_end, metric_value::DOUBLE AS v, row_number() OVER (PARTITION BY symbol, metric_name ORDER BY period_end DESC) AS rn
FROM stock_metrics WHERE fiscal_period = 'FY' AND metric_name IN ('revenue', 'net_income', 'eps_diluted')"""),
    "growth_pairs": (["annual"], """
SELECT n.symbol, n.metric_name, k AS years, n.v AS v_new, n.period_end AS new_at, arg_max(o.v, o.period_end) AS v_old, max(o.period_end) AS old_at
FROM annual n CROSS JOIN (VALUES (1), (3)) y(k) JOIN annual o ON o.symbol = n.symbol AND o.metric_name = n.metric_name
 AND year(o.period_end) <= year(n.period_end) - k WHERE n.rn = 1 GROUP BY 1, 2, 3, 4, 5"""),
    "growth": (["growth_pairs"], """
SELECT symbol, years, max(g) FILTER (WHERE metric_name = 'revenue') AS revenue_growth, max(g) FILTER (WHERE metric_name = 'eps_diluted') AS eps_growth,
 max(g) FILTER (WHERE metric_name = 'net_income') AS net_income_growth
FROM (SELECT *, CASE WHEN years = 1 THEN (v_new - v_old) / abs(v_old) WHEN v_new > 0 THEN
  pow(v_new / v_old, 1 / (date_diff('day', old_at, new_at) / 365.25::DOUBLE)) - 1 END AS g FROM growth_pairs WHERE v_old > 0) x GROUP BY 1, 2"""),
    "facts_long": (["raw_series", "stock_metrics"], f"""
SELECT symbol, metric_name, day, arg_max(v, pref) AS v FROM (
SELECT symbol, metric_name, period_end AS day, ttm_value AS v, {_PREF} AS pref FROM raw_series WHERE ttm_value IS NOT NULL
 AND metric_name IN ('eps_diluted', 'eps_basic', 'revenue', 'net_income', 'operating_income')
UNION ALL SELECT symbol, metric_name, period_end, metric_value::DOUBLE, {_PREF} FROM stock_metrics
 WHERE metric_name IN ('shares_outstanding', 'stockholders_equity', 'total_assets', 'total_liabilities', 'cash_and_equivalents')
UNION ALL SELECT a.symbol, 'shares_outstanding', a.period_end, a.metric_value::DOUBLE / b.metric_value::DOUBLE, 5
 FROM stock_metrics a JOIN stock_metrics b ON a.symbol = b.symbol AND a.period_end = b.period_end AND a.fiscal_period = 'FY' AND b.fiscal_period = 'FY'
 WHERE a.metric_name = 'net_income' AND b.metric_name = 'eps_diluted' AND a.metric_value <> 0 AND b.metric_value <> 0
  AND a.metric_value::DOUBLE / b.metric_value::DOUBLE > 0
  AND a.symbol NOT IN (SELECT symbol FROM stock_metrics WHERE metric_name = 'shares_outstanding')) f GROUP BY 1, 2, 3"""),
    "history_inputs": (["facts_long", "daily_prices"], "SELECT p.symbol, p.price_date, p.adj_close::DOUBLE AS price, " + ", ".join(
        f"{a}.v AS {m}" for a, m in (("s", "shares_outstanding"), ("e", "stockholders_equity"), ("l", "total_liabilities"),
                                     ("c", "cash_and_equivalents"), ("d", "eps_diluted"), ("b", "eps_basic"), ("r", "revenue"), ("o", "operating_income"))
    ) + " FROM daily_prices p " + " ".join(
        f"ASOF LEFT JOIN (SELECT * FROM facts_long WHERE metric_name = '{m}') {a} ON {a}.symbol = p.symbol AND {a}.day <= p.price_date"
        for a, m in (("s", "shares_outstanding"), ("e", "stockholders_equity"), ("l", "total_liabilities"),
                     ("c", "cash_and_equivalents"), ("d", "eps_diluted"), ("b", "eps_basic"), ("r", "revenue"), ("o", "operating_income"))
    )),
    "history": (["history_inputs"], """
SELECT symbol, price_date, price, CASE WHEN eps > 0 THEN price / eps END AS pe_ttm, CASE WHEN stockholders_equity > 0 THEN cap / stockholders_equity END AS pb,
 CASE WHEN revenue > 0 THEN cap / revenue END AS ps,
 CASE WHEN operating_income > 0 THEN nullif(cap + total_liabilities - cash_and_equivalents, 0) / operating_income END AS ev_ebitda
FROM (SELECT *, price * shares_outstanding AS cap, coalesce(nullif(eps_diluted, 0), eps_basic) AS eps FROM history_inputs WHERE shares_outstanding > 0) x"""),
    "history_long": (["history"], " UNION ALL ".join(
        f"SELECT symbol, price_date, '{r}' AS ratio, {r} AS v FROM history WHERE {r} IS NOT NULL" for r in X.HISTORY_RATIOS)),
    "summary": (["history_long"], """
SELECT symbol, ratio, current, avg(v) AS mean, min(v) AS low, max(v) AS high, count(*) AS n,
 CASE WHEN count(*) >= 4 THEN count(*) FILTER (WHERE v < current) / count(*) * 100 END AS percentile
FROM history_long JOIN (SELECT symbol, ratio, arg_max(v, price_date) AS current FROM history_long GROUP BY 1, 2) c USING (symbol, ratio) GROUP BY 1, 2, 3"""),
    "valued": (["ratios", "growth", "summary"], f"""
SELECT *, {_CATEGORY} FROM (SELECT r.* REPLACE ({', '.join(f'coalesce(hist_{x}, r.{x}) AS {x}' for x in X.HISTORY_RATIOS)}),
  g.revenue_growth, g.eps_growth, g.net_income_growth, {', '.join(f'{x}_pctl, n_{x}' for x in X.HISTORY_RATIOS)},
  CASE WHEN eps_growth * 100 > 0 THEN coalesce(hist_pe_ttm, r.pe_ttm) / (eps_growth * 100) END AS peg
 FROM ratios r LEFT JOIN (SELECT * FROM growth WHERE years = 1) g ON g.symbol = r.symbol
 LEFT JOIN (SELECT symbol, {', '.join(f"max(current) FILTER (WHERE ratio = '{x}') AS hist_{x}, max(percentile) FILTER (WHERE ratio = '{x}') AS {x}_pctl, max(n) FILTER (WHERE ratio = '{x}') AS n_{x}" for x in X.HISTORY_RATIOS)}
  FROM summary GROUP BY 1) s ON s.symbol = r.symbol) z"""),
    "scored": (["valued"], f"""
SELECT v.*, preset, (coalesce(score_valuation * wv, 0) + coalesce(score_profitability * wp, 0) + coalesce(score_health * wh, 0) + coalesce(score_growth * wg, 0))
 / nullif(CASE WHEN score_valuation IS NULL THEN 0 ELSE wv END + CASE WHEN score_profitability IS NULL THEN 0 ELSE wp END
  + CASE WHEN score_health IS NULL THEN 0 ELSE wh END + CASE WHEN score_growth IS NULL THEN 0 ELSE wg END, 0) AS score_composite
FROM valued v CROSS JOIN (SELECT preset, a::DOUBLE AS wv, b::DOUBLE AS wp, c::DOUBLE AS wh, d::DOUBLE AS wg FROM (VALUES {_PRESETS}) p(preset, a, b, c, d)) w"""),
}


def _ratios(spark, sf):
    spot = latest_prices(V.daily_prices(spark, sf)).select("symbol", F.col("adj_close").cast("double").alias("price"))
    return X.ratios(X.valuation_inputs(V.stored(V.stock_metrics, spark, sf)).join(spot, "symbol"))


def _valued(spark, sf):
    return X.valuation(V.stored(V.stock_metrics, spark, sf), V.stored(V.daily_prices, spark, sf))


def _history(spark, sf):
    return X.ratio_history(V.stored(V.stock_metrics, spark, sf), V.daily_prices(spark, sf))


@query("ratios", ("ratios",), f"SELECT symbol, price, {_rounded(RATIO_DIGITS)} FROM ratios", extra=VAL)
def ratios(spark, sf):
    return show(_ratios(spark, sf).select("symbol", "price", *RATIO_DIGITS), **RATIO_DIGITS)


_GROWTH = {g: 9 for g in X.GROWTH_METRICS.values()}


@query("growth_1y", ("growth",), f"SELECT symbol, {_rounded(_GROWTH)} FROM growth WHERE years = 1", extra=VAL)
def growth_1y(spark, sf):
    return show(X.growth(V.stock_metrics(spark, sf), 1), **_GROWTH)


@query("growth_3y", ("growth",), f"SELECT symbol, {_rounded(_GROWTH)} FROM growth WHERE years = 3", extra=VAL)
def growth_3y(spark, sf):
    return show(X.growth(V.stock_metrics(spark, sf), 3), **_GROWTH)


@query("ratio_history", ("history",), f"SELECT symbol, price_date, price, {_rounded({r: 5 for r in X.HISTORY_RATIOS})} FROM history",
       extra=VAL, days=("price_date",))
def ratio_history(spark, sf):
    return show(_history(spark, sf), **{r: 5 for r in X.HISTORY_RATIOS})


@query("ratio_percentiles", ("summary",), """
SELECT symbol, ratio, round(current, 6) AS current, round(mean, 4) AS mean, round(low, 6) AS low, round(high, 5) AS high, n,
 round(percentile, 9) AS percentile FROM summary""", extra=VAL)
def ratio_percentiles(spark, sf):
    history = _history(spark, sf)
    return show(X.history_summary(history).where("n > 0"), current=6, mean=4, low=6, high=5, percentile=9)


_SCORES = {c: 7 for c in ["score_composite", *[f"score_{k}" for k in X.SCORED_RATIOS]]}


@query("fundamental_score", ("scored",), f"SELECT symbol, preset, {_rounded(_SCORES)}, round(peg, 6) AS peg FROM scored", extra=VAL)
def fundamental_score(spark, sf):
    return show(_valued(spark, sf).select("symbol", "preset", *_SCORES, "peg"), **_SCORES, peg=6)


@query("score_ranking", ("scored",), """
SELECT symbol, preset, round(score_composite, 1) AS score_composite, row_number() OVER (PARTITION BY preset
 ORDER BY round(score_composite, 1) DESC NULLS LAST, symbol) AS rank FROM scored""", extra=VAL)
def score_ranking(spark, sf):
    return show(X.score_table(written_once(_valued(spark, sf))).select("symbol", "preset", "score_composite", "rank"))


_PCTL = {"pe_percentile": "pe_ttm_pctl", "pb_percentile": "pb_pctl", "ps_percentile": "ps_pctl", "ev_ebitda_percentile": "ev_ebitda_pctl"}


def _snapshot_digits(m: str) -> int:
    return 1 if m in ("market_cap", "enterprise_value") else 6


@query("valuation_snapshot", ("scored",), "SELECT symbol, DATE '2001-12-31' AS snapshot_date, preset, price AS price_used, " + ", ".join(
    f"round_even({_PCTL.get(m, m)}, {_snapshot_digits(m)}) AS {m}" for m in SNAPSHOT_MEASURES) + " FROM scored", extra=VAL, days=("snapshot_date",))
def valuation_snapshot(spark, sf):
    return show(X.snapshots(_valued(spark, sf), V.AS_OF), market_cap=1, enterprise_value=1)


# Two companies that do not report what a ratio history needs.
_SILENT = "symbol IN ('Brand#5', 'Brand#6') AND metric_name IN ('shares_outstanding', 'eps_diluted')"
PARTLY = {**VAL, "stock_metrics": (VIEWS["stock_metrics"][0], f"SELECT * FROM ({VIEWS['stock_metrics'][1].strip()}) reported WHERE NOT ({_SILENT})")}


@query("missing_history", ("valued",), f"""
SELECT symbol, {', '.join(f'coalesce(n_{r}, 0) AS n_{r}' for r in X.HISTORY_RATIOS)} FROM valued
WHERE coalesce({', '.join(f'{r}_pctl' for r in X.HISTORY_RATIOS)}) IS NULL""", extra=PARTLY)
def missing_history(spark, sf):
    metrics = V.stored(V.stock_metrics, spark, sf).where(~F.expr(_SILENT))
    return show(X.missing_history(X.valuation(metrics, V.stored(V.daily_prices, spark, sf))))


@query("symbol_coverage", ("history", "daily_prices", "stock_metrics", "positions"), """
SELECT symbol, first_day, last_day, n_bars, n_metrics, n_shares, n_pe_ttm, n_pb, n_ps, n_ev_ebitda,
 CASE WHEN n_bars > 0 THEN 1 ELSE 0 END + CASE WHEN n_metrics > 0 THEN 2 ELSE 0 END + CASE WHEN n_shares > 0 THEN 4 ELSE 0 END AS present,
 concat_ws(',', CASE WHEN n_bars = 0 THEN 'prices' END, CASE WHEN n_metrics = 0 THEN 'metrics' END, CASE WHEN n_shares = 0 THEN 'shares' END,
  CASE WHEN n_pe_ttm < 4 THEN 'pe_ttm' END, CASE WHEN n_pb < 4 THEN 'pb' END, CASE WHEN n_ps < 4 THEN 'ps' END, CASE WHEN n_ev_ebitda < 4 THEN 'ev_ebitda' END) AS missing
FROM (SELECT s.symbol, first_day, last_day, coalesce(n_bars, 0) AS n_bars, coalesce(n_metrics, 0) AS n_metrics, coalesce(n_shares, 0) AS n_shares,
  coalesce(n_pe_ttm, 0) AS n_pe_ttm, coalesce(n_pb, 0) AS n_pb, coalesce(n_ps, 0) AS n_ps, coalesce(n_ev_ebitda, 0) AS n_ev_ebitda
 FROM (SELECT symbol FROM daily_prices UNION SELECT symbol FROM stock_metrics UNION SELECT symbol FROM positions WHERE asset_class IN ('STK', 'ETF') UNION SELECT 'UNLISTED') s
 LEFT JOIN (SELECT symbol, min(price_date) AS first_day, max(price_date) AS last_day, count(*) AS n_bars FROM daily_prices GROUP BY 1) p ON p.symbol = s.symbol
 LEFT JOIN (SELECT symbol, count(*) AS n_metrics, count(*) FILTER (WHERE metric_name = 'shares_outstanding') AS n_shares FROM stock_metrics GROUP BY 1) m ON m.symbol = s.symbol
 LEFT JOIN (SELECT symbol, count(pe_ttm) AS n_pe_ttm, count(pb) AS n_pb, count(ps) AS n_ps, count(ev_ebitda) AS n_ev_ebitda FROM history GROUP BY 1) h ON h.symbol = s.symbol) x""",
       extra=VAL, days=("first_day", "last_day"))
def symbol_coverage(spark, sf):
    """Every symbol that is quoted, reported or held, and one that is in no source."""
    held = V.positions(spark, sf).where(F.col("asset_class").isin("STK", "ETF")).select("symbol")
    wanted = held.unionByName(spark.createDataFrame([("UNLISTED",)], "symbol string"))
    found = X.coverage(V.stored(V.stock_metrics, spark, sf), V.stored(V.daily_prices, spark, sf), wanted)
    return show(found.withColumn("missing", F.array_join("missing", ",")))


_STATS = {**{f"weighted_{r}": 8 for r in X.WEIGHTED_RATIOS}, "weighted_pe_ttm": 5, "earnings_yield_on_cost": 9, "herfindahl": 5, "top_holding_pct": 7}


@query("portfolio_stats", ("positions_latest", "ratios"), f"""
SELECT account_id, {', '.join(f'round({c}, {d}) AS {c}' for c, d in _STATS.items())}, num_holdings,
 CASE WHEN herfindahl < 1500 THEN 'Diversified' WHEN herfindahl < 2500 THEN 'Moderate' ELSE 'Concentrated' END AS label
FROM (SELECT account_id, {', '.join(f'sum({r} * mv) / nullif(sum(mv) FILTER (WHERE {r} IS NOT NULL), 0) AS weighted_{r}' for r in X.WEIGHTED_RATIOS)},
  coalesce(sum(earnings_yield * mv), 0) / sum(cost) AS earnings_yield_on_cost, sum(share * share) AS herfindahl, max(share) AS top_holding_pct, count(*) AS num_holdings
 FROM (SELECT account_id, r.*, abs(market_value)::DOUBLE AS mv, abs(cost_basis)::DOUBLE AS cost,
   abs(market_value)::DOUBLE / sum(abs(market_value)) OVER (PARTITION BY account_id)::DOUBLE * 100 AS share
  FROM positions_latest p JOIN ratios r ON r.symbol = p.symbol WHERE asset_class IN ('STK', 'ETF')) x GROUP BY 1) y""", extra=VAL)
def portfolio_stats(spark, sf):
    return show(X.portfolio_stats(_latest(spark, sf), _ratios(spark, sf)), **_STATS)


# --- snapshot table over time -----------------------------------------------------------------

SNAPS = {
    **VAL,
    "snaps": (["history", "stock_metrics"], """
SELECT symbol, make_date(y, 12, 31) AS snapshot_date, preset, arg_max(price, price_date) AS price_used, arg_max(pb, price_date) FILTER (WHERE pb IS NOT NULL) AS pb
FROM history JOIN (SELECT unnest(generate_series(lo, hi)) AS y FROM (SELECT min(year(price_date)) AS lo, max(year(price_date)) AS hi FROM history) b) ys ON year(price_date) <= y
 CROSS JOIN (SELECT unnest(['Balanced', 'Value', 'Growth', 'Quality']) AS preset) p GROUP BY 1, 2, 3"""),
}


def _snaps(spark, sf):
    """Year-end snapshot rows of every preset and year, derived from the ratio history.

    The newest values of each year are carried on to years without prices of the symbol.
    """
    history = _history(spark, sf)
    year = F.year("price_date")
    years = history.agg(F.sequence(F.min(year), F.max(year)).alias("years")).scalar()
    by_year = history.groupBy("symbol", year.alias("y")).agg(
        F.max_by("price", "price_date").alias("price"), F.max_by("pb", F.when(F.col("pb").isNotNull(), F.col("price_date"))).alias("pb"))
    listed = by_year.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("y", "price", "pb"))).alias("known"))

    def newest(field):
        return F.try_element_at(F.filter("known", lambda k: (k["y"] <= F.col("year_end")) & k[field].isNotNull()), F.lit(-1))[field]

    presets = F.explode(F.array(*[F.lit(p) for p in VALUATION_PRESETS]))
    return (
        listed.select("symbol", "known", F.explode(years).alias("year_end"))
        .select("symbol", F.make_date("year_end", F.lit(12), F.lit(31)).alias("snapshot_date"),
                newest("price").alias("price_used"), newest("pb").alias("pb"))
        .where(F.col("price_used").isNotNull()).withColumn("preset", presets)
    )


@query("snapshot_history", ("snaps",), """
SELECT symbol, snapshot_date, preset, price_used, round(pb, 6) AS pb FROM snaps
WHERE preset = 'Value' AND snapshot_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'""", extra=SNAPS, days=("snapshot_date",))
def snapshot_history(spark, sf):
    rows = _snaps(spark, sf).where(
        (F.col("preset") == "Value") & F.col("snapshot_date").between(F.lit(date(1998, 1, 1)), F.lit(date(2000, 12, 31)))
    )
    return show(rows.orderBy("snapshot_date"), pb=6)


@query("latest_snapshot", ("snaps",), """
SELECT symbol, preset, max(snapshot_date) AS snapshot_date, arg_max(price_used, snapshot_date) AS price_used,
 round(arg_max(pb, snapshot_date) FILTER (WHERE pb IS NOT NULL OR TRUE), 6) AS pb FROM snaps GROUP BY 1, 2""", extra=SNAPS, days=("snapshot_date",))
def latest_snapshot(spark, sf):
    newest = K.latest_value(_snaps(spark, sf), ["symbol", "preset"], ["price_used", "pb"], "snapshot_date")
    return show(newest, pb=6)


@query("upsert_snapshots", ("snaps",), """
SELECT symbol, snapshot_date, preset, price_used + CASE WHEN snapshot_date >= DATE '2000-01-01' THEN 1 ELSE 0 END AS price_used FROM snaps""",
       extra=SNAPS, days=("snapshot_date",))
def upsert_snapshots(spark, sf):
    rows = written_once(_snaps(spark, sf).drop("pb"))
    stored = rows.where(F.col("snapshot_date") < F.lit(date(2001, 1, 1)))
    loaded = rows.where(F.col("snapshot_date") >= F.lit(date(2000, 1, 1))).withColumn("price_used", F.col("price_used") + 1)
    return show(K.upsert(stored, loaded, ["symbol", "snapshot_date", "preset"], [F.col("price_used").desc()]))


@query("upsert_metrics", ("stock_metrics",), """
SELECT symbol, metric_name, period_end, fiscal_period, (metric_value * CASE WHEN period_end >= DATE '2000-01-01' THEN 2 ELSE 1 END)::DOUBLE AS metric_value
FROM stock_metrics""", days=("period_end",))
def upsert_metrics(spark, sf):
    rows = V.stock_metrics(spark, sf)
    stored = rows.where(F.col("period_end") < F.lit(date(2001, 1, 1)))
    loaded = rows.where(F.col("period_end") >= F.lit(date(2000, 1, 1))).withColumn("metric_value", F.col("metric_value") * 2)
    keys = ["symbol", "metric_name", "period_end", "fiscal_period"]
    return show(K.upsert(stored, loaded, keys, [F.col("fetched_at").desc()]).select(*keys, "metric_value"))


@query("delete_metrics", ("stock_metrics",), """
SELECT symbol, count(*) AS rows FROM stock_metrics WHERE symbol NOT IN ('Brand#3', 'Brand#12') GROUP BY 1""")
def delete_metrics(spark, sf):
    rows = V.stock_metrics(spark, sf)
    doomed = spark.createDataFrame([(" brand#3 ",), ("BRAND#12",)], "name string").select(F.initcap(F.trim("name")).alias("symbol"))
    return K.delete_keys(rows, doomed, ["symbol"]).groupBy("symbol").agg(F.count("*").alias("rows"))


# --- scores at every year end -----------------------------------------------------------------

_ALL_METRICS = FLOW_METRICS + POINT_METRICS
AS_OF = {
    **VAL,
    "score_days": (["daily_prices"], """
SELECT make_date(y, 12, 31) AS day FROM (SELECT unnest(generate_series(min(year(price_date)), max(year(price_date)))) AS y FROM daily_prices) x"""),
    "facts_all": (["raw_series", "stock_metrics"], f"""
SELECT m.symbol, m.metric_name, m.period_end AS reported, {_PREF.replace('fiscal_period', 'm.fiscal_period')} AS pref,
 CASE WHEN m.fiscal_period <> 'FY' THEN coalesce(s.ttm_value, m.metric_value::DOUBLE) ELSE m.metric_value::DOUBLE END AS v
FROM stock_metrics m LEFT JOIN raw_series s ON s.symbol = m.symbol AND s.metric_name = m.metric_name AND s.period_end = m.period_end AND s.fiscal_period = m.fiscal_period"""),
    "newest_facts": (["facts_all", "score_days"], """
SELECT symbol, day, metric_name, v FROM (SELECT f.*, d.day, row_number() OVER (PARTITION BY symbol, metric_name, d.day ORDER BY reported DESC, pref DESC) AS rn
 FROM facts_all f JOIN score_days d ON f.reported <= d.day) x WHERE rn = 1"""),
    "newest_growth": (["stock_metrics", "score_days"], """
SELECT symbol, day, max(g) FILTER (WHERE metric_name = 'revenue') AS revenue_growth, max(g) FILTER (WHERE metric_name = 'eps_diluted') AS eps_growth,
 max(g) FILTER (WHERE metric_name = 'net_income') AS net_income_growth
FROM (SELECT n.symbol, n.metric_name, n.day, CASE WHEN arg_max(o.v, o.period_end) > 0 THEN (any_value(n.v) - arg_max(o.v, o.period_end)) / abs(arg_max(o.v, o.period_end)) END AS g
 FROM (SELECT m.symbol, m.metric_name, d.day, max(m.period_end) AS period_end, arg_max(m.metric_value::DOUBLE, m.period_end) AS v
  FROM stock_metrics m JOIN score_days d ON m.period_end <= d.day WHERE fiscal_period = 'FY' AND metric_name IN ('revenue', 'net_income', 'eps_diluted') GROUP BY 1, 2, 3) n
 LEFT JOIN (SELECT symbol, metric_name, period_end, metric_value::DOUBLE AS v FROM stock_metrics WHERE fiscal_period = 'FY') o
  ON o.symbol = n.symbol AND o.metric_name = n.metric_name AND year(o.period_end) <= year(n.period_end) - 1 GROUP BY 1, 2, 3) x GROUP BY 1, 2"""),
    "inputs_as_of": (["newest_facts", "newest_growth", "daily_prices", "score_days"], f"""
SELECT i.*, p.price, g.revenue_growth, g.eps_growth, g.net_income_growth
FROM (SELECT symbol, day, {', '.join(_filter(m) for m in _ALL_METRICS)} FROM newest_facts GROUP BY 1, 2) i
JOIN (SELECT symbol, day, arg_max(adj_close, price_date)::DOUBLE AS price FROM daily_prices JOIN score_days ON price_date <= day GROUP BY 1, 2) p ON p.symbol = i.symbol AND p.day = i.day
LEFT JOIN newest_growth g ON g.symbol = i.symbol AND g.day = i.day"""),
    "ratios_as_of": (["inputs_as_of"], VAL["ratios"][1].replace("FROM inputs", "FROM inputs_as_of")),
    "current_as_of": (["history_long", "score_days"], """
SELECT symbol, day, ratio, arg_max(v, price_date) AS current FROM history_long JOIN score_days ON price_date <= day GROUP BY 1, 2, 3"""),
    "percentiles_as_of": (["current_as_of", "history_long"], """
SELECT c.symbol, c.day, c.ratio, any_value(c.current) AS current,
 CASE WHEN count(*) >= 4 THEN count(*) FILTER (WHERE h.v < c.current) / count(*) * 100 END AS percentile
FROM current_as_of c JOIN history_long h ON h.symbol = c.symbol AND h.ratio = c.ratio AND h.price_date <= c.day GROUP BY 1, 2, 3"""),
    "valued_as_of": (["ratios_as_of", "percentiles_as_of"], f"""
SELECT *, {_CATEGORY} FROM (SELECT r.* REPLACE ({', '.join(f'coalesce(hist_{x}, r.{x}) AS {x}' for x in X.HISTORY_RATIOS)}), {', '.join(f'{x}_pctl' for x in X.HISTORY_RATIOS)},
  CASE WHEN eps_growth * 100 > 0 THEN coalesce(hist_pe_ttm, r.pe_ttm) / (eps_growth * 100) END AS peg
 FROM ratios_as_of r LEFT JOIN (SELECT symbol, day, {', '.join(f"max(current) FILTER (WHERE ratio = '{x}') AS hist_{x}, max(percentile) FILTER (WHERE ratio = '{x}') AS {x}_pctl" for x in X.HISTORY_RATIOS)}
  FROM percentiles_as_of GROUP BY 1, 2) s ON s.symbol = r.symbol AND s.day = r.day) z"""),
    "scored_as_of": (["valued_as_of"], VAL["scored"][1].replace("FROM valued v", "FROM valued_as_of v")),
}


def _score_history(spark, sf):
    metrics, prices = V.stored(V.stock_metrics, spark, sf), V.stored(V.daily_prices, spark, sf)
    year = F.year("price_date")
    first, last = prices.agg(F.min(year), F.max(year)).first()
    return X.score_history(metrics, prices, [date(y, 12, 31) for y in range(first, last + 1)])


@query("score_history", ("scored_as_of",), f"""
SELECT symbol, day AS snapshot_date, preset, price, {_rounded(_SCORES)}, {', '.join(f'round({r}_pctl, 9) AS {r}_pctl' for r in X.HISTORY_RATIOS)}, round(peg, 6) AS peg
FROM scored_as_of""", extra=AS_OF, days=("snapshot_date",))
def score_history(spark, sf):
    columns = ["symbol", "snapshot_date", "preset", "price", *_SCORES, *[f"{r}_pctl" for r in X.HISTORY_RATIOS], "peg"]
    return show(_score_history(spark, sf).select(*columns), **_SCORES, **{f"{r}_pctl": 9 for r in X.HISTORY_RATIOS}, peg=6)
