from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioforge.operators import fundamentals as U
from folioforge.operators import valuation as X

SCHEMA = ("symbol string, metric_name string, metric_value decimal(28,6), period_end date, fiscal_period string, fiscal_year int,"
          " duration_days int, reporting_style string, filing_type string, source string")


def rows(symbol, metric, entries, style=None):
    return [(symbol, metric, None if v is None else Decimal(str(v)), date.fromisoformat(pe), fp, fy, days, style, "10-K" if fp == "FY" else "10-Q", "SEC_EDGAR")
            for v, pe, fp, fy, days in entries]


def frame(spark, *groups):
    return spark.createDataFrame([r for g in groups for r in g], SCHEMA)


YTD = [(25000, "2024-03-31", "Q1", 2024, 90), (53000, "2024-06-30", "Q2", 2024, 181), (80000, "2024-09-30", "Q3", 2024, 273),
       (108000, "2024-12-31", "FY", 2024, 365)]


def quarters(df, **kw):
    return {(r.fiscal_year, r.quarter): (r.isolated_value, r.method) for r in U.isolate_quarters(df, **kw).collect()}


def test_cumulative_quarters(spark):
    got = quarters(frame(spark, rows("A", "revenue", YTD)))
    assert [got[(2024, q)][0] for q in ("Q1", "Q2", "Q3", "Q4")] == [25000, 28000, 27000, 28000]
    assert got[(2024, "Q1")][1] == "direct" and got[(2024, "Q4")][1] == "subtracted"


def test_missing_prior_quarter_and_annual_only(spark):
    got = quarters(frame(spark, rows("A", "revenue", [YTD[0], YTD[2], YTD[3]]), rows("B", "revenue", [YTD[3]])))
    assert (2024, "Q3") not in got
    only = U.isolate_quarters(frame(spark, rows("B", "revenue", [YTD[3]]))).first()
    assert (only.method, only.isolated_value) == ("annual_only", 108000)


def test_standalone_and_rolling_ttm(spark):
    standalone = [(20000, "2024-03-31", "Q1", 2024, 90), (22000, "2024-06-30", "Q2", 2024, 90), (23000, "2024-09-30", "Q3", 2024, 91),
                  (90000, "2024-12-31", "FY", 2024, 365), (25000, "2025-03-31", "Q1", 2025, 89)]
    cumulative = [(23000, "2024-03-31", "Q1", 2024, 90), (48000, "2024-06-30", "Q2", 2024, 181), (74000, "2024-09-30", "Q3", 2024, 273),
                  (100000, "2024-12-31", "FY", 2024, 365), (26000, "2025-03-31", "Q1", 2025, 89)]
    df = frame(spark, rows("S", "revenue", standalone), rows("C", "revenue", cumulative), rows("T", "revenue", standalone, "standalone_quarterly"))
    series = U.trailing_series(df)
    latest = {r.symbol: (r.ttm_value, r.ttm_method) for r in U.latest_trailing(series).collect()}
    assert latest == {"S": (95000, "sum_4q"), "C": (103000, "sum_4q"), "T": (95000, "sum_4q")}
    ytd = {(r.symbol, r.fiscal_period): r.is_ytd for r in series.where("fiscal_year = 2024").collect()}
    assert ytd[("C", "Q2")] and not ytd[("S", "Q2")] and not ytd[("C", "Q1")]
    assert {r.symbol: r.quarterly_value for r in U.latest_quarter(U.isolate_quarters(df)).collect()} == {"S": 25000, "C": 26000, "T": 25000}


def test_non_calendar_year_zero_fallback_and_sanity(spark):
    odd = [(30000, "2023-12-30", "Q1", 2024, 91), (65000, "2024-03-30", "Q2", 2024, 182), (98000, "2024-06-29", "Q3", 2024, 273),
           (130000, "2024-09-28", "FY", 2024, 364)]
    df = frame(spark, rows("N", "revenue", odd)).withColumn("normalized_value", F.lit(0))
    got = quarters(df, value="normalized_value")
    assert [got[(2024, q)][0] for q in ("Q1", "Q2", "Q3", "Q4")] == [30000, 35000, 33000, 32000]
    bad = frame(spark, rows("B", "revenue", [(50000, "2024-03-31", "Q1", 2024, 90), (20000, "2024-06-30", "Q2", 2024, 181),
                                             (80000, "2024-09-30", "Q3", 2024, 273), (108000, "2024-12-31", "FY", 2024, 365)]))
    report = U.quarter_sanity(U.isolate_quarters(bad)).first()
    assert report.negative_quarters == 1 and not report.sum_mismatch


def shares(*entries):
    return [(v, pe, "FY", int(pe[:4]), None) for v, pe in entries]


def test_split_detection(spark):
    df = frame(
        spark,
        rows("H", "shares_outstanding", shares((1_000_000, "2023-12-31"), (4_000_000, "2024-12-31"))),
        rows("H", "eps_diluted", shares((8, "2023-12-31"), (2, "2024-12-31"))),
        rows("O", "shares_outstanding", shares((1_000_000, "2023-12-31"), (700_000, "2024-12-31"))),
        rows("R", "shares_outstanding", shares((1_000_000, "2023-12-31"), (100_000, "2024-12-31"))),
    )
    got = {r.symbol: (r.confidence, r.label) for r in U.detect_splits(df).collect()}
    assert got == {"H": ("high", "4:1"), "R": ("medium", "1:10")}
    assert U.detect_splits(df).where("symbol = 'H'").first().reason == (
        "count of shares times 4.0000, near a 4:1 split; earnings per share times 0.2500, where the inverse is 0.2500")


def test_cumulative_split_normalization(spark):
    df = frame(
        spark,
        rows("M", "shares_outstanding", shares((100, "2021-12-31"), (200, "2022-12-31"), (600, "2023-12-31"))),
        rows("M", "eps_diluted", shares((12, "2021-12-31"), (6, "2022-12-31"), (2, "2023-12-31"))),
        rows("M", "revenue", shares((5, "2021-12-31"))),
    )
    out = U.normalize_splits(df, U.detect_splits(df)).orderBy("metric_name", "period_end").collect()
    assert [r.normalized_value for r in out if r.metric_name == "eps_diluted"] == [2, 2, 2]
    assert [r.normalized_value for r in out if r.metric_name == "shares_outstanding"] == [600, 600, 600]
    assert [r.split_adjusted for r in out if r.metric_name == "revenue"] == [False]


def test_history_golden_values_and_implied_shares(spark):
    eps = [(3, "2023-03-31", "Q1", 2023, 90), (3, "2023-06-30", "Q2", 2023, 90), (3, "2023-09-30", "Q3", 2023, 91), (12, "2023-12-31", "FY", 2023, 365)]
    df = frame(
        spark,
        rows("A", "eps_diluted", eps, "standalone_quarterly"), rows("A", "shares_outstanding", shares((1000, "2023-12-31"))),
        rows("I", "eps_diluted", eps, "standalone_quarterly"), rows("I", "net_income", shares((1200, "2023-12-31"))),
        rows("I", "stockholders_equity", shares((6000, "2023-12-31"))),
    )
    prices = spark.createDataFrame([(s, d, p) for s in "AI" for d, p in ((date(2023, 6, 1), 90.0), (date(2024, 1, 2), 120.0), (date(2024, 1, 3), 180.0))],
                                   "symbol string, price_date date, adj_close double")
    got = {(r.symbol, r.price_date.day): r for r in X.ratio_history(df, prices).collect()}
    assert got[("A", 2)].pe_ttm == pytest.approx(10) and got[("A", 3)].pe_ttm == pytest.approx(15) and len(got) == 4
    assert got[("I", 2)].pb == pytest.approx(120 * 100 / 6000) and got[("A", 2)].pb is None


def test_percentile_growth_and_ratio_nulls(spark):
    history = spark.createDataFrame([("A", date(2024, 1, d), float(v)) for d, v in enumerate([1, 2, 3, 4, 6, 7, 8, 9, 10, 5], 1)], "symbol string, price_date date, pe_ttm double")
    history = history.withColumns({c: F.lit(None).cast("double") for c in ("pb", "ps", "ev_ebitda")})
    summary = {r.ratio: r for r in X.history_summary(history).collect()}
    assert summary["pe_ttm"].percentile == 40.0 and summary["pb"].percentile is None
    few = {r.ratio: r for r in X.history_summary(history.where("price_date <= '2024-01-03'")).collect()}
    assert few["pe_ttm"].percentile is None and few["pe_ttm"].current == 3
    df = frame(spark, rows("A", "revenue", shares((100, "2020-12-31"), (120, "2022-12-31"), (150, "2023-12-31"))),
               rows("N", "revenue", shares((-5, "2022-12-31"), (10, "2023-12-31"))))
    assert {r.symbol: r.revenue_growth for r in X.growth(df, 1).collect()} == {"A": pytest.approx(0.25)}
    assert X.growth(df, 3).first().revenue_growth == pytest.approx(1.5 ** (365.25 / 1095) - 1)


def test_score_presets_and_bounds(spark):
    assert all(sum(w.values()) == pytest.approx(1.0) for w in X.SCORE_PRESETS.values())
    r = spark.range(1).select(X.score_absolute(F.lit(0.0), True).alias("zero"), X.score_absolute(F.lit(9.0), True).alias("big"),
                              X.score_absolute(F.lit(0.0), False).alias("low"), X.score_absolute(F.lit(None).cast("double"), True).alias("none")).first()
    assert r.zero == 50 and r.big == pytest.approx(100) and r.low == 100 and r.none is None
