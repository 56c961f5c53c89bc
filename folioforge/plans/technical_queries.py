"""Queries over daily bars: signals, scores, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions.scores import LINEAR_BOUNDS, PRESET_WEIGHTS, SEGMENTS, SIGNALS
from folioforge.operators import technical as TA
from folioforge.plans import views as V
from folioforge.plans.registry import query, show

TECH = {
    "series": (["daily_prices"], """
SELECT symbol, price_date, adj_close::DOUBLE AS c, high::DOUBLE AS h, low::DOUBLE AS l, volume::DOUBLE AS v,
 row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n, lag(adj_close::DOUBLE) OVER w AS p
FROM daily_prices WINDOW w AS (PARTITION BY symbol ORDER BY price_date)"""),
    "ema": (["series"], """
SELECT symbol, rn, c, v, (s).e12 AS e12, (s).e26 AS e26 FROM (SELECT * FROM (
 WITH RECURSIVE r(symbol, rn, c, v, s) AS (
  SELECT symbol, rn, c, v, {'e12': c, 'e26': c} FROM series WHERE rn = 1
  UNION ALL SELECT x.symbol, x.rn, x.c, x.v, {'e12': x.c * (2/13) + r.s.e12 * (11/13), 'e26': x.c * (2/27) + r.s.e26 * (25/27)}
  FROM r JOIN series x ON x.symbol = r.symbol AND x.rn = r.rn + 1) SELECT * FROM r) q) z"""),
    "macd_lines": (["ema", "series"], """
SELECT * FROM (WITH RECURSIVE m(symbol, rn, e12, e26, sig) AS (
  SELECT symbol, rn, e12, e26, e12 - e26 FROM ema WHERE rn = 1
  UNION ALL SELECT x.symbol, x.rn, x.e12, x.e26, (x.e12 - x.e26) * 0.2::DOUBLE + m.sig * 0.8::DOUBLE
  FROM m JOIN ema x ON x.symbol = m.symbol AND x.rn = m.rn + 1) SELECT * FROM m) q"""),
    "obv": (["series"], """
SELECT symbol, rn, sum(CASE WHEN p IS NULL THEN 0 ELSE sign(c - p) * v END) OVER (PARTITION BY symbol ORDER BY rn) AS obv FROM series"""),
    "tech": (["series", "macd_lines", "obv"], """
SELECT symbol, n, close,
 CASE WHEN n >= 252 THEN c21 / c252 - 1 END AS momentum_12_1,
 CASE WHEN n >= 15 AND loss <> 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi_14,
 CASE WHEN n >= 200 THEN (close - sma200) / sma200 * 0.5::DOUBLE + (close - sma50) / sma50 * 0.3::DOUBLE + CASE WHEN sma50 > sma200 THEN 0.2 ELSE -0.2 END
  WHEN n >= 50 THEN (close - sma50) / sma50 END AS sma_trend,
 CASE WHEN n >= 21 THEN vol * sqrt(252) END AS realized_vol_20,
 CASE WHEN n >= 50 AND v50 > 0 THEN v20 / v50 END AS volume_trend,
 CASE WHEN n >= 35 AND close > 0 THEN hist / close END AS macd,
 CASE WHEN n >= 20 AND sd20 > 0 THEN (close - (sma20 - 2 * sd20)) / (4 * sd20) END AS bollinger_pctb,
 CASE WHEN n >= 15 AND close > 0 THEN atr / close END AS atr_pct,
 CASE WHEN n >= 21 AND v20 > 0 THEN slope / v20 END AS obv_trend,
 CASE WHEN n >= 21 THEN close / c21 - 1 END AS roc_20,
 CASE WHEN n >= 50 THEN close >= sma50 END AS above_sma50, CASE WHEN n >= 100 THEN close >= sma100 END AS above_sma100,
 CASE WHEN n >= 200 THEN close >= sma200 END AS above_sma200
FROM (SELECT s.symbol, any_value(n) AS n, max(c) FILTER (WHERE n - s.rn = 0) AS close, max(c) FILTER (WHERE n - s.rn = 20) AS c21,
  max(c) FILTER (WHERE n - s.rn = 251) AS c252,
  avg(CASE WHEN c > p THEN c - p ELSE 0 END) FILTER (WHERE n - s.rn < 14) AS gain,
  avg(CASE WHEN c < p THEN p - c ELSE 0 END) FILTER (WHERE n - s.rn < 14) AS loss,
  avg(c) FILTER (WHERE n - s.rn < 20) AS sma20, avg(c) FILTER (WHERE n - s.rn < 50) AS sma50,
  avg(c) FILTER (WHERE n - s.rn < 100) AS sma100, avg(c) FILTER (WHERE n - s.rn < 200) AS sma200,
  stddev_samp(c) FILTER (WHERE n - s.rn < 20) AS sd20, stddev_samp(ln(c / p)) FILTER (WHERE n - s.rn < 20) AS vol,
  avg(v) FILTER (WHERE n - s.rn < 20) AS v20, avg(v) FILTER (WHERE n - s.rn < 50) AS v50,
  avg(greatest(h - l, abs(h - p), abs(l - p))) FILTER (WHERE n - s.rn < 14) AS atr,
  max(e12 - e26 - sig) FILTER (WHERE n - s.rn = 0) AS hist,
  regr_slope(obv, s.rn) FILTER (WHERE n - s.rn < 20) AS slope
 FROM series s JOIN macd_lines m ON m.symbol = s.symbol AND m.rn = s.rn JOIN obv o ON o.symbol = s.symbol AND o.rn = s.rn
 GROUP BY 1) a"""),
}


def _linear_sql(name: str) -> str:
    low, high = LINEAR_BOUNDS[name]
    return f"greatest(0, least(100, ({name} - ({low})) / (({high}) - ({low})) * 100))"


def _segment_sql(name: str) -> str:
    arms = []
    for upper, (r0, r1), (s0, s1) in SEGMENTS[name]:
        test = f"{name} <= {upper}" if upper is not None else "TRUE"
        arms.append(f"WHEN {test} THEN greatest({min(s0, s1)}, least({max(s0, s1)}, {s0} + ({name} - {r0}) / ({r1} - {r0}) * ({s1} - {s0})))")
    return "CASE " + " ".join(arms) + " END"


_SCORES = ", ".join(
    f"CASE WHEN {s} IS NOT NULL THEN round({_linear_sql(s) if s in LINEAR_BOUNDS else _segment_sql(s)}::DOUBLE, 1) END AS {s}_score"
    for s in SIGNALS
)
_WEIGHT_ROWS = ", ".join(
    f"('{p}', {i}, {w}::DOUBLE)" for p, ws in PRESET_WEIGHTS.items() for i, w in enumerate(ws)
)
TECH["tech_scored"] = (["tech"], f"SELECT *, {_SCORES} FROM tech WHERE n >= 15")
TECH["tech_ranked"] = (["tech_scored"], f"""
SELECT symbol, preset, composite, row_number() OVER (PARTITION BY preset ORDER BY composite DESC NULLS LAST, symbol) AS rank
FROM (SELECT symbol, preset, round(sum(score * w) / sum(w), 1) AS composite
 FROM (SELECT symbol, unnest([{', '.join(f'{s}_score' for s in SIGNALS)}]) AS score, unnest(range(10)) AS i FROM tech_scored) u
 JOIN (VALUES {_WEIGHT_ROWS}) w(preset, i, w) USING (i) WHERE score IS NOT NULL GROUP BY 1, 2) c""")

_RAW = ", ".join(f"round({s}, 8) AS {s}" for s in SIGNALS)


@query("tech_signals", ("tech",), f"""
SELECT symbol, n, close, {_RAW}, above_sma50, above_sma100, above_sma200 FROM tech""", extra=TECH)
def tech_signals(spark, sf):
    return show(TA.signals(V.daily_prices(spark, sf)).drop("last_date"), **{s: 8 for s in SIGNALS})


@query("tech_scores", ("tech_scored",), f"SELECT symbol, {', '.join(f'{s}_score' for s in SIGNALS)} FROM tech_scored", extra=TECH)
def tech_scores(spark, sf):
    scored = TA.scores(TA.signals(V.daily_prices(spark, sf)).where(F.col("n") >= TA.MIN_ROWS))
    return show(scored.select("symbol", *[f"{s}_score" for s in SIGNALS]))


@query("tech_ranking", ("tech_ranked", "tech"), f"""
SELECT symbol, preset, composite, rank, CASE WHEN composite IS NULL THEN 'none' WHEN composite >= 70 THEN 'high'
 WHEN composite >= 40 THEN 'mid' ELSE 'low' END AS band, {_RAW}, above_sma50, above_sma100, above_sma200
FROM tech_ranked JOIN tech USING (symbol)""", extra=TECH)
def tech_ranking(spark, sf):
    ranked = TA.ranking(V.daily_prices(spark, sf)).select(
        "symbol", "preset", "composite", "rank", "band", *SIGNALS, "above_sma50", "above_sma100", "above_sma200")
    return show(ranked, **{s: 8 for s in SIGNALS})


@query("realized_vol", ("series",), """
SELECT symbol, round(CASE WHEN any_value(n) >= 21 THEN stddev_samp(ln(c / p)) FILTER (WHERE n - rn < 20) * sqrt(252) END, 8) AS realized_vol
FROM series GROUP BY 1""", extra=TECH)
def realized_vol(spark, sf):
    return show(TA.realized_volatility(V.daily_prices(spark, sf)), realized_vol=8)


# Averages of 4-decimal prices over 50 or 200 days end within 7 decimals, the other lines do not end.
_LINES = {"sma50": 8, "sma200": 8, "ema12": 5, "ema26": 5, "macd": 5, "macd_signal": 5, "boll_upper": 5, "boll_lower": 5}


@query("indicator_series", ("series", "macd_lines", "obv"), f"""
SELECT symbol, price_date, obv, {', '.join(f'round({x}, {d}) AS {x}' for x, d in _LINES.items())} FROM (
 SELECT s.symbol, price_date, obv, CASE WHEN s.rn >= 50 THEN avg(c) OVER (w ROWS 49 PRECEDING) END AS sma50,
  CASE WHEN s.rn >= 200 THEN avg(c) OVER (w ROWS 199 PRECEDING) END AS sma200, e12 AS ema12, e26 AS ema26,
  e12 - e26 AS macd, sig AS macd_signal,
  CASE WHEN s.rn >= 20 THEN avg(c) OVER (w ROWS 19 PRECEDING) + 2 * stddev_samp(c) OVER (w ROWS 19 PRECEDING) END AS boll_upper,
  CASE WHEN s.rn >= 20 THEN avg(c) OVER (w ROWS 19 PRECEDING) - 2 * stddev_samp(c) OVER (w ROWS 19 PRECEDING) END AS boll_lower
 FROM series s JOIN macd_lines m ON m.symbol = s.symbol AND m.rn = s.rn JOIN obv o ON o.symbol = s.symbol AND o.rn = s.rn
 WINDOW w AS (PARTITION BY s.symbol ORDER BY s.rn)) x""", extra=TECH, days=("price_date",))
def indicator_series(spark, sf):
    return show(TA.indicator_series(V.daily_prices(spark, sf)).drop("sma20"), **_LINES)
