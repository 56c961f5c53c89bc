"""Queries over the long fundamentals table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import fundamentals as U
from folioforge.operators.lineage import written_once
from folioforge.plans import views as V
from folioforge.plans.registry import query, show
from folioforge.schemas import FLOW_METRICS

_FLOW_LIST = ", ".join(f"'{m}'" for m in FLOW_METRICS)
_PREF = "CASE WHEN fiscal_period = 'FY' THEN 5 ELSE coalesce(TRY_CAST(substr(fiscal_period, 2, 1) AS INT), 0) END"
_COMMON = "[2, 3, 4, 5, 7, 8, 10, 15, 20, 1/2, 1/3, 1/4, 1/5, 1/8, 1/10, 1/15, 1/20, 3/2, 4/3, 5/4]"


def half_even_sql(x: str, digits: int) -> str:
    """Half-even rounding of the shortest decimal form of a double, as Spark's bround does it.

    Ties matter for small per-share values only; large amounts are rounded directly.
    """
    text = f"TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(30,20))"
    d = f"({text} * {10 ** digits})"
    return (f"CASE WHEN abs({x}) < 1000000 THEN CAST(CASE WHEN {d} - floor({d}) = 0.5 AND floor({d}) % 2 = 0 THEN floor({d}) / {10 ** digits}"
            f" ELSE round({text}, {digits}) END AS DOUBLE) ELSE round_even({x}, {digits}) END")


def ttm_views(prefix: str, source: str) -> dict:
    """Isolated quarters and trailing values over ``source`` (symbol, metric_name, period columns, val)."""
    return {
        f"{prefix}_latest": ([source], f"""
SELECT symbol, metric_name, coalesce(fiscal_year, year(period_end)) AS fy, fiscal_period AS fp,
 arg_max(val, period_end) AS val, max(period_end) AS pe FROM {source} WHERE fiscal_period IS NOT NULL AND val IS NOT NULL GROUP BY 1, 2, 3, 4"""),
        f"{prefix}_style": ([source], f"""
SELECT symbol, metric_name, coalesce(arg_max(reporting_style, period_end) FILTER (WHERE reporting_style IS NOT NULL AND reporting_style <> 'unknown'),
 CASE WHEN s AND l THEN 'mixed' WHEN l THEN 'cumulative_ytd' WHEN s THEN 'standalone_quarterly' WHEN q THEN 'cumulative_ytd' ELSE 'annual_only' END) AS style
FROM {source} JOIN (SELECT symbol AS sy, metric_name AS mn,
 coalesce(bool_or(fiscal_period IN ('Q2','Q3') AND duration_days <= 100), FALSE) AS s,
 coalesce(bool_or(fiscal_period IN ('Q2','Q3') AND duration_days > 100 AND duration_days <= 290), FALSE) AS l,
 coalesce(bool_or(fiscal_period IN ('Q1','Q2','Q3','Q4')), FALSE) AS q FROM {source} GROUP BY 1, 2) e
 ON symbol = sy AND metric_name = mn GROUP BY symbol, metric_name, s, l, q"""),
        f"{prefix}_iso": ([f"{prefix}_latest", f"{prefix}_style"], f"""
SELECT *, row_number() OVER (PARTITION BY symbol, metric_name ORDER BY fy, quarter, CASE WHEN fp = 'FY' THEN 0 ELSE 1 END) AS pos FROM (
SELECT a.symbol, a.metric_name, a.fy, a.fp, style, CASE WHEN a.fp = 'FY' THEN 'Q4' ELSE a.fp END AS quarter, a.pe, a.val AS ytd,
 CASE WHEN style = 'standalone_quarterly' THEN CASE WHEN a.fp <> 'FY' THEN a.val
   ELSE coalesce({half_even_sql('a.val - (q1.val + q2.val + q3.val)', 4)}, a.val) END
  WHEN a.fp = 'Q1' THEN a.val WHEN a.fp = 'Q2' THEN {half_even_sql('a.val - q1.val', 4)} WHEN a.fp = 'Q3' THEN {half_even_sql('a.val - q2.val', 4)}
  ELSE coalesce({half_even_sql('a.val - q3.val', 4)}, a.val) END AS isolated,
 CASE WHEN style = 'standalone_quarterly' THEN CASE WHEN a.fp <> 'FY' THEN 'standalone'
   WHEN q1.val IS NOT NULL AND q2.val IS NOT NULL AND q3.val IS NOT NULL THEN 'subtracted' ELSE 'annual_only' END
  WHEN a.fp = 'Q1' THEN 'direct' WHEN a.fp IN ('Q2', 'Q3') THEN 'subtracted' WHEN q3.val IS NOT NULL THEN 'subtracted'
  ELSE 'annual_only' END AS method
FROM {prefix}_latest a JOIN {prefix}_style USING (symbol, metric_name)
LEFT JOIN {prefix}_latest q1 ON q1.symbol = a.symbol AND q1.metric_name = a.metric_name AND q1.fy = a.fy AND q1.fp = 'Q1'
LEFT JOIN {prefix}_latest q2 ON q2.symbol = a.symbol AND q2.metric_name = a.metric_name AND q2.fy = a.fy AND q2.fp = 'Q2'
LEFT JOIN {prefix}_latest q3 ON q3.symbol = a.symbol AND q3.metric_name = a.metric_name AND q3.fy = a.fy AND q3.fp = 'Q3') x
WHERE isolated IS NOT NULL"""),
        f"{prefix}_ttm": ([f"{prefix}_iso"], f"""
SELECT symbol, metric_name, pe, arg_max(isolated, pos) AS quarterly_value,
 arg_max(ttm, pos) FILTER (WHERE ttm IS NOT NULL) AS ttm, arg_max(tm, pos) FILTER (WHERE ttm IS NOT NULL) AS ttm_method
FROM (SELECT *, CASE WHEN method = 'annual_only' THEN ytd WHEN k = 4 AND labels = 4 THEN {half_even_sql('s4', 4)} END AS ttm,
  CASE WHEN method = 'annual_only' THEN 'annual' WHEN k = 4 AND labels = 4 THEN 'sum_4q' END AS tm
 FROM (SELECT *, count(*) OVER w AS k, len(list_distinct(list(quarter) OVER w)) AS labels, lag(isolated, 3) OVER v + lag(isolated, 2) OVER v + lag(isolated) OVER v + isolated AS s4 FROM {prefix}_iso
  WINDOW w AS (PARTITION BY symbol, metric_name ORDER BY pos ROWS 3 PRECEDING), v AS (PARTITION BY symbol, metric_name ORDER BY pos)) y) z GROUP BY 1, 2, 3"""),
        f"{prefix}_series": ([f"{prefix}_ttm", f"{prefix}_style", source], f"""
SELECT m.symbol, m.metric_name, m.period_end, m.fiscal_period, t.quarterly_value,
 CASE WHEN fiscal_period = 'FY' AND t.ttm IS NULL THEN val ELSE t.ttm END AS ttm_value,
 CASE WHEN fiscal_period = 'FY' AND t.ttm IS NULL THEN 'annual' ELSE t.ttm_method END AS ttm_method,
 fiscal_period IN ('Q2', 'Q3') AND style <> 'standalone_quarterly' AS is_ytd
FROM {source} m LEFT JOIN {prefix}_ttm t ON t.symbol = m.symbol AND t.metric_name = m.metric_name AND t.pe = m.period_end
LEFT JOIN {prefix}_style s ON s.symbol = m.symbol AND s.metric_name = m.metric_name"""),
    }


FUND = {
    "flows": (["stock_metrics"], f"SELECT *, metric_value::DOUBLE AS val FROM stock_metrics WHERE metric_name IN ({_FLOW_LIST})"),
    **ttm_views("raw", "flows"),
    "shares_eps": (["stock_metrics"], f"""
SELECT a.symbol, a.period_end, a.shares, b.eps FROM (SELECT symbol, period_end, arg_max(metric_value::DOUBLE, {_PREF}) AS shares
  FROM stock_metrics WHERE metric_name = 'shares_outstanding' GROUP BY 1, 2) a
LEFT JOIN (SELECT symbol, period_end, arg_max(metric_value::DOUBLE, {_PREF}) AS eps FROM stock_metrics WHERE metric_name = 'eps_diluted' GROUP BY 1, 2) b
 ON a.symbol = b.symbol AND a.period_end = b.period_end"""),
    "splits": (["shares_eps"], f"""
SELECT *, CASE WHEN eps <> 0 AND pe0 <> 0 AND abs(eps / pe0 - 1 / ratio) / abs(1 / ratio) <= 0.10 THEN 'high' ELSE 'medium' END AS confidence
FROM (SELECT symbol, period_end, lag(period_end) OVER w AS prior_period_end, shares, lag(shares) OVER w AS s0, eps, lag(eps) OVER w AS pe0,
 shares / lag(shares) OVER w AS ratio FROM shares_eps WINDOW w AS (PARTITION BY symbol ORDER BY period_end)) x
WHERE s0 > 0 AND shares > 0 AND abs(ratio - 1) > 0.15
 AND EXISTS (SELECT 1 FROM (SELECT unnest({_COMMON}) AS c) k WHERE abs(ratio - c) / c <= 0.08)"""),
    "normalized": (["stock_metrics", "splits"], f"""
SELECT m.*, coalesce(factor, 1) AS factor, CASE WHEN coalesce(factor, 1) <> 1 AND metric_name IN ('eps_basic', 'eps_diluted') THEN {half_even_sql('metric_value::DOUBLE / factor', 4)}
  WHEN coalesce(factor, 1) <> 1 AND metric_name = 'shares_outstanding' THEN round_even(metric_value::DOUBLE * factor, 0) ELSE metric_value::DOUBLE END AS val,
 coalesce(factor, 1) <> 1 AND metric_name IN ('eps_basic', 'eps_diluted', 'shares_outstanding') AS split_adjusted
FROM stock_metrics m LEFT JOIN (SELECT d.symbol, d.period_end, product(ratio) AS factor FROM (SELECT DISTINCT symbol, period_end FROM stock_metrics) d
 JOIN splits s ON s.symbol = d.symbol AND d.period_end < s.period_end GROUP BY 1, 2) f ON f.symbol = m.symbol AND f.period_end = m.period_end"""),
    "norm_flows": (["normalized"], f"SELECT * FROM normalized WHERE metric_name IN ({_FLOW_LIST})"),
    **ttm_views("norm", "norm_flows"),
    "latest": (["normalized"], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, metric_name ORDER BY period_end DESC, {_PREF} DESC, duration_days DESC NULLS LAST) AS rn
 FROM normalized) x WHERE rn = 1"""),
    "norm_ttm_latest": (["norm_series"], """
SELECT symbol, metric_name, arg_max(ttm_value, period_end) FILTER (WHERE ttm_value IS NOT NULL) AS ttm_value,
 arg_max(ttm_method, period_end) FILTER (WHERE ttm_value IS NOT NULL) AS ttm_method FROM norm_series GROUP BY 1, 2"""),
    "norm_quarter_latest": (["norm_iso"], """
SELECT symbol, metric_name, arg_max(isolated, pos) AS quarterly_value, arg_max(quarter, pos) AS quarter, arg_max(method, pos) AS method
FROM norm_iso WHERE method <> 'annual_only' GROUP BY 1, 2"""),
    "display": (["latest", "norm_ttm_latest", "norm_quarter_latest"], f"""
SELECT l.symbol, l.metric_name, period_end, fiscal_period, filing_type,
 CASE WHEN l.metric_name IN ({_FLOW_LIST}) THEN coalesce(quarterly_value, ttm_value, metric_value::DOUBLE) ELSE val END AS value
FROM latest l LEFT JOIN norm_ttm_latest t ON t.symbol = l.symbol AND t.metric_name = l.metric_name
LEFT JOIN norm_quarter_latest q ON q.symbol = l.symbol AND q.metric_name = l.metric_name
WHERE l.metric_name IN ({', '.join(f"'{m}'" for m in U.DISPLAY_METRICS)})"""),
}


def _display(spark, sf):
    return U.display_values(V.stored(V.stock_metrics, spark, sf))


def _flows(spark, sf):
    return V.stock_metrics(spark, sf).where(U.is_flow())


@query("metrics_of_symbol", ("stock_metrics",), """
SELECT symbol, metric_name, metric_value::DOUBLE AS metric_value, period_end, fiscal_period, fiscal_year::BIGINT AS fiscal_year,
 duration_days::BIGINT AS duration_days, reporting_style, filing_type FROM stock_metrics WHERE symbol = 'BRAND#7' OR symbol = 'Brand#7'""",
       days=("period_end",))
def metrics_of_symbol(spark, sf):
    rows = V.stock_metrics(spark, sf).where(F.upper("symbol") == "BRAND#7").orderBy(F.col("period_end").desc())
    return show(rows.select("symbol", "metric_name", "metric_value", "period_end", "fiscal_period", "fiscal_year",
                            "duration_days", "reporting_style", "filing_type"))


@query("latest_metrics", ("latest",), """
SELECT symbol, metric_name, metric_value::DOUBLE AS metric_value, period_end, fiscal_period FROM latest""", extra=FUND, days=("period_end",))
def latest_metrics(spark, sf):
    return show(U.latest_metrics(V.stock_metrics(spark, sf)).select("symbol", "metric_name", "metric_value", "period_end", "fiscal_period"))


@query("metric_styles", ("raw_style",), "SELECT symbol, metric_name, style FROM raw_style", extra=FUND)
def metric_styles(spark, sf):
    return U.reporting_styles(_flows(spark, sf))


@query("isolated_quarters", ("raw_iso",), """
SELECT symbol, metric_name, fy::BIGINT AS fiscal_year, quarter, pe AS period_end, ytd AS ytd_value, isolated AS isolated_value, method
FROM raw_iso""", extra=FUND, days=("period_end",))
def isolated_quarters(spark, sf):
    return show(U.isolate_quarters(_flows(spark, sf)).drop("seq", "style"))


@query("ttm_series", ("raw_series",), "SELECT * FROM raw_series", extra=FUND, days=("period_end",))
def ttm_series(spark, sf):
    return show(U.trailing_series(_flows(spark, sf)).select(
        "symbol", "metric_name", "period_end", "fiscal_period", "quarterly_value", "ttm_value", "ttm_method", "is_ytd"))


@query("ttm_latest", ("norm_ttm_latest",), "SELECT * FROM norm_ttm_latest", extra=FUND)
def ttm_latest(spark, sf):
    metrics = V.stored(V.stock_metrics, spark, sf)
    flows = U.normalize_splits(metrics, U.detect_splits(metrics)).where(U.is_flow())
    return show(U.latest_trailing(U.trailing_series(flows, "normalized_value")))


@query("quarterly_latest", ("norm_quarter_latest",), "SELECT * FROM norm_quarter_latest", extra=FUND)
def quarterly_latest(spark, sf):
    metrics = V.stored(V.stock_metrics, spark, sf)
    flows = U.normalize_splits(metrics, U.detect_splits(metrics)).where(U.is_flow())
    return show(U.latest_quarter(U.isolate_quarters(flows, "normalized_value")))


@query("quarter_sanity", ("raw_iso",), """
SELECT symbol, metric_name, fy::BIGINT AS fiscal_year, negative_quarters, round(quarter_sum, 3) AS quarter_sum, annual_value,
 coalesce(abs(quarter_sum - annual_value) > CASE WHEN annual_value <> 0 THEN abs(annual_value) * 0.01 ELSE 1 END, FALSE) AS sum_mismatch
FROM (SELECT symbol, metric_name, fy, count(*) FILTER (WHERE isolated < 0 AND method IN ('subtracted', 'standalone')) AS negative_quarters,
 sum(isolated) AS quarter_sum, CASE WHEN arg_min(method, pos) FILTER (WHERE quarter = 'Q4') = 'subtracted'
  THEN arg_min(ytd, pos) FILTER (WHERE quarter = 'Q4') END AS annual_value FROM raw_iso GROUP BY 1, 2, 3) y""", extra=FUND)
def quarter_sanity(spark, sf):
    return show(U.quarter_sanity(U.isolate_quarters(_flows(spark, sf))), quarter_sum=3)


@query("splits", ("splits",), """
SELECT symbol, period_end, prior_period_end, ratio AS shares_ratio, confidence,
 CASE WHEN ratio < 1 THEN '1:' || CAST(round_even(1 / ratio, 0) AS BIGINT) WHEN abs(ratio - round_even(ratio, 0)) < 0.15
  THEN CAST(round_even(ratio, 0) AS BIGINT) || ':1' ELSE printf('%.2f:1', ratio) END AS label FROM splits""",
       extra=FUND, days=("period_end", "prior_period_end"))
def splits(spark, sf):
    return show(U.detect_splits(V.stock_metrics(spark, sf)).drop("reason"))


@query("split_normalized", ("normalized",), """
SELECT symbol, metric_name, period_end, fiscal_period, round(factor, 8) AS split_factor, val AS normalized_value, split_adjusted FROM normalized""",
       extra=FUND, days=("period_end",))
def split_normalized(spark, sf):
    metrics = V.stored(V.stock_metrics, spark, sf)
    return show(U.normalize_splits(metrics, U.detect_splits(metrics)).select(
        "symbol", "metric_name", "period_end", "fiscal_period", "split_factor", "normalized_value", "split_adjusted"), split_factor=8)


@query("normalized_latest", ("latest",), """
SELECT symbol, metric_name, val AS normalized_value, split_adjusted FROM latest
WHERE metric_name IN ('eps_basic', 'eps_diluted', 'shares_outstanding')""", extra=FUND)
def normalized_latest(spark, sf):
    metrics = V.stored(V.stock_metrics, spark, sf)
    rows = U.normalize_splits(U.latest_metrics(metrics), U.detect_splits(metrics))
    return show(rows.where(F.col("metric_name").isin("eps_basic", "eps_diluted", "shares_outstanding"))
                .select("symbol", "metric_name", "normalized_value", "split_adjusted"))


@query("metric_display", ("display",), "SELECT * FROM display", extra=FUND, days=("period_end",))
def metric_display(spark, sf):
    return show(_display(spark, sf))


@query("metric_overview", ("display",), "SELECT symbol, " + ", ".join(
    f"max(value) FILTER (WHERE metric_name = '{m}') AS {m}" for m in U.DISPLAY_METRICS) + " FROM display GROUP BY 1", extra=FUND)
def metric_overview(spark, sf):
    return show(U.wide_display(_display(spark, sf)))


@query("metric_kpis", ("display",), """
SELECT count(DISTINCT symbol) AS symbols, round(sum(value) FILTER (WHERE metric_name = 'revenue'), 2) AS total_revenue,
 round(sum(value) FILTER (WHERE metric_name = 'net_income'), 2) AS total_net_income,
 round(sum(value) FILTER (WHERE metric_name = 'stockholders_equity'), 2) AS total_equity,
 round(sum(value) FILTER (WHERE metric_name = 'cash_and_equivalents'), 2) AS total_cash FROM display""", extra=FUND)
def metric_kpis(spark, sf):
    wide = U.wide_display(_display(spark, sf))
    return show(U.kpi_totals(wide), total_revenue=2, total_net_income=2, total_equity=2, total_cash=2)


@query("zscore_matrix", ("display",), f"""
SELECT symbol, metric_name, value, round((value - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 8) AS z FROM (
 SELECT symbol, metric_name, value, avg(value) OVER p AS m, stddev_samp(value) OVER p AS sd FROM display
 WHERE metric_name IN ({', '.join(f"'{m}'" for m in U.HEATMAP_METRICS)}) WINDOW p AS (PARTITION BY metric_name)) x""", extra=FUND)
def zscore_matrix(spark, sf):
    return show(U.z_scores(written_once(_display(spark, sf))), z=8)
