import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.functions.scores import PRESET_WEIGHTS, SIGNALS, rounded_score
from folioforge.operators import beta as B
from folioforge.operators import prices as P
from folioforge.operators import technical as TA
from folioforge.operators import valuation as X


def make(symbol, n, seed):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.015, n)))
    return pd.DataFrame({
        "symbol": symbol, "price_date": [date(2020, 1, 1) + timedelta(days=i) for i in range(n)], "open": close,
        "high": close * (1 + rng.uniform(0, 0.01, n)), "low": close * (1 - rng.uniform(0, 0.01, n)), "close": close,
        "adj_close": close, "volume": rng.integers(1000, 5000, n),
    })


def expected(df):
    """Independent pandas computation of the last-row signals."""
    c, h, l, v = df["adj_close"], df["high"], df["low"], df["volume"].astype(float)
    d = c.diff()
    out = {}
    n = len(c)
    out["momentum_12_1"] = c.iloc[-21] / c.iloc[-252] - 1 if n >= 252 else None
    out["rsi_14"] = 100 - 100 / (1 + d.clip(lower=0).tail(14).mean() / (-d.clip(upper=0)).tail(14).mean())
    out["realized_vol_20"] = np.log(c / c.shift()).tail(20).std() * np.sqrt(252) if n >= 21 else None
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    out["macd"] = (line - line.ewm(span=9, adjust=False).mean()).iloc[-1] / c.iloc[-1] if n >= 35 else None
    m, s = c.tail(20).mean(), c.tail(20).std()
    out["bollinger_pctb"] = (c.iloc[-1] - m + 2 * s) / (4 * s) if n >= 20 else None
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    out["atr_pct"] = tr.tail(14).mean() / c.iloc[-1]
    obv = (np.sign(d) * v).fillna(0).cumsum()
    out["obv_trend"] = np.polyfit(np.arange(20), obv.tail(20), 1)[0] / v.tail(20).mean() if n >= 21 else None
    out["roc_20"] = c.iloc[-1] / c.iloc[-21] - 1 if n >= 21 else None
    out["volume_trend"] = v.tail(20).mean() / v.tail(50).mean() if n >= 50 else None
    return out


@pytest.fixture(scope="module")
def frames():
    return {s: make(s, n, i) for i, (s, n) in enumerate([("AAA", 300), ("BBB", 210), ("CCC", 60), ("DDD", 20), ("EEE", 10)])}


@pytest.fixture(scope="module")
def prices(spark, frames):
    return spark.createDataFrame(pd.concat(frames.values()))


def test_signals_match_pandas(prices, frames):
    rows = {r.symbol: r for r in TA.signals(prices).collect()}
    for symbol in ("AAA", "BBB", "CCC", "DDD"):
        for name, want in expected(frames[symbol]).items():
            got = rows[symbol][name]
            assert (got is None) == (want is None), (symbol, name)
            if want is not None:
                assert got == pytest.approx(want, rel=1e-9), (symbol, name)
    assert rows["EEE"].rsi_14 is None and rows["CCC"].above_sma100 is None and rows["AAA"].above_sma200 is not None


def test_flat_prices_have_no_rsi(spark):
    flat = make("F", 60, 1)
    for c in ("open", "high", "low", "close", "adj_close"):
        flat[c] = 50.0
    r = TA.signals(spark.createDataFrame(flat)).first()
    assert r.rsi_14 is None and r.bollinger_pctb is None and r.macd == pytest.approx(0.0, abs=1e-12)


def test_ranking_presets_and_weights(prices):
    assert all(sum(w) == pytest.approx(1.0) for w in PRESET_WEIGHTS.values())
    rows = TA.ranking(prices).collect()
    assert {r.symbol for r in rows} == {"AAA", "BBB", "CCC", "DDD"} and len(rows) == 12
    for preset in PRESET_WEIGHTS:
        mine = sorted((r for r in rows if r.preset == preset), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4]
        assert [r.composite for r in mine] == sorted((r.composite for r in mine), reverse=True)


def test_scores_stay_in_range_and_contrarian(spark):
    grid = spark.range(-300, 301).select((F.col("id") / 2.0).alias("x"))
    for s in SIGNALS:
        r = grid.select(rounded_score(s, F.col("x")).alias("y")).agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
        assert 0 <= r.lo and r.hi <= 100, s
    r = spark.range(1).select(*[rounded_score("rsi_14", F.lit(float(v))).alias(f"r{v}") for v in (20, 30, 50, 70, 80)],
                              rounded_score("macd", F.lit(None).cast("double")).alias("none")).first()
    assert r.r20 > r.r30 > r.r50 > r.r70 > r.r80 and (r.r30, r.r50, r.r70) == (80.0, 50.0, 30.0) and r.none is None


def test_beta(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(0.0005, 0.02, 400)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(400)]
    series = lambda name, r: pd.DataFrame({"symbol": name, "price_date": days[: len(r)], "adj_close": 100 * np.exp(np.cumsum(r))})
    target = 1.4 * m + rng.normal(0, 0.005, 400)
    bench = spark.createDataFrame(series("MKT", m))
    stocks = spark.createDataFrame(pd.concat([series("T", target), series("SELF", m), series("SHORT", m[:50])]))
    got = {r.symbol: r.beta for r in B.betas(stocks, bench).collect()}
    tail = slice(400 - 251, 400)
    assert got["T"] == pytest.approx(np.cov(target[tail], m[tail])[0, 1] / m[tail].var(ddof=1), rel=1e-9)
    assert got["SELF"] == pytest.approx(1.0, abs=1e-9) and got["SHORT"] is None


def test_price_gaps_and_normalization(spark):
    raw = spark.createDataFrame([(" aapl ", "2024-01-02", "1.23456", "2", "1", "1.5", None, "10"), ("x", "bad", "1", "2", "1", "z", "1", "10")],
                                "symbol string, price_date string, open string, high string, low string, close string, adj_close string, volume string")
    rows = P.normalize_prices(raw).collect()
    assert rows[0].symbol == "AAPL" and float(rows[0].open) == 1.2346 and rows[0].adj_close == rows[0].close and rows[1].price_date is None
    bars = spark.createDataFrame([("A", date(2024, 2, 1)), ("A", date(2024, 3, 1))], "symbol string, price_date date")
    req = spark.createDataFrame([("A", date(2024, 1, 1), date(2024, 4, 1)), ("A", date(2024, 2, 1), date(2024, 3, 1)), ("B", date(2024, 1, 1), date(2024, 1, 9))],
                                "symbol string, start date, end date")
    gaps = sorted((r.symbol, r.gap_start, r.gap_end) for r in P.missing_ranges(req, bars).collect())
    assert gaps == [("A", date(2024, 1, 1), date(2024, 1, 31)), ("A", date(2024, 3, 2), date(2024, 4, 1)), ("B", date(2024, 1, 1), date(2024, 1, 9))]


def test_percentiles_and_facts_as_of_many_days(spark):
    """Each day sees what a run over the rows up to that day would see."""
    rng = random.Random(7)
    start, rows = date(2020, 1, 1), []
    for symbol, n in (("A", 400), ("B", 90), ("C", 3)):
        for i in range(n):
            day = start + timedelta(days=2 * i)
            rows.append((symbol, day, 1.0, *[rng.choice([None, round(rng.uniform(1, 5), 1)]) for _ in range(4)]))
    names = "symbol string, price_date date, price double, pe_ttm double, pb double, ps double, ev_ebitda double"
    days = [date(2019, 12, 31), date(2020, 1, 9), date(2020, 6, 30), date(2021, 3, 1), date(2023, 1, 1)]
    got = {(r.symbol, r.period): r for r in X.percentiles_as_of(spark.createDataFrame(rows, names).repartition(3), days).collect()}
    seen = 0
    for symbol in "ABC":
        for period, day in enumerate(days):
            for k, ratio in enumerate(X.HISTORY_RATIOS):
                values = [r[3 + k] for r in rows if r[0] == symbol and r[1] <= day and r[3 + k] is not None]
                r = got.get((symbol, period))
                if not values:
                    assert r is None or r[f"hist_{ratio}"] is None
                    continue
                seen += 1
                assert r[f"hist_{ratio}"] == values[-1]
                want = 100 * sum(v < values[-1] for v in values) / len(values) if len(values) >= 4 else None
                assert r[f"{ratio}_pctl"] == pytest.approx(want)
    assert seen > 40

    def fact(symbol, metric, end, value, period):
        return (symbol, metric, Decimal(value), end, period, "10-K", end.year, None, None)
    facts = [fact("A", "total_assets", date(2019, 12, 31), 5, "FY"), fact("A", "total_assets", date(2020, 6, 30), 7, "Q2"),
             fact("A", "revenue", date(2018, 12, 31), 50, "FY"), fact("A", "revenue", date(2019, 12, 31), 60, "FY"), fact("A", "revenue", date(2020, 12, 31), 30, "FY"),
             fact("B", "total_assets", date(2022, 12, 31), 9, "FY")]
    schema = "symbol string, metric_name string, metric_value decimal(28,6), period_end date, fiscal_period string, filing_type string, fiscal_year int, duration_days int, reporting_style string"
    found = {(r.symbol, r.period): r for r in X.facts_as_of(spark.createDataFrame(facts, schema), days).collect()}
    assert [found["A", p].total_assets for p in range(5)] == [5, 5, 7, 7, 7] and [p for s, p in found if s == "B"] == [4]
    assert [found["A", p].revenue_growth for p in range(5)] == pytest.approx([0.2, 0.2, 0.2, -0.5, -0.5])
    assert [found["A", p].revenue for p in range(5)] == [60, 60, 60, 30, 30]
    with pytest.raises(ValueError, match="no days"):
        X.score_history(None, None, [])
