"""Technical signals over daily bars, for all symbols in one shuffle.

Bars are unique per (symbol, day), so a symbol's partition is bounded by the trading calendar. One
exchange on the symbol serves the row numbers, the lag and the final per-symbol aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.numeric import as_double, positive, safe_div
from folioforge.functions.scores import PRESET_WEIGHTS, SIGNALS, composite, rounded_score, score_band
from folioforge.operators.scans import exponential_average, rank_by_score

TRADING_DAYS = 252
MIN_ROWS = 15


def numbered(prices: DataFrame) -> DataFrame:
    """Bars as doubles with position from both ends and the previous close, on one sort order."""
    by_date = Window.partitionBy("symbol").orderBy("price_date")
    rows = F.count("*").over(Window.partitionBy("symbol"))
    c = F.col("c")
    return (
        prices.select(
            "symbol", "price_date", as_double("adj_close").alias("c"), as_double("high").alias("h"),
            as_double("low").alias("l"), as_double("volume").alias("v"),
        )
        .withColumn("rn", F.row_number().over(by_date))
        .withColumn("prev", F.lag("c").over(by_date))
        .withColumn("back", rows - F.col("rn") + 1)
        .withColumn("ret", F.ln(c / F.col("prev")))
    )


def _tail(value: Column, n: int) -> Column:
    """The value on the last ``n`` rows, null elsewhere."""
    return F.when(F.col("back") <= n, value)


def _at(k: int, value: str = "c") -> Column:
    """Value on the k-th row from the end."""
    return F.max(F.when(F.col("back") == k, F.col(value)))


def _ema_weight(alpha: float, seed: Column) -> Column:
    """Weight of a row, ``back - 1`` steps old, in a recursive average seeded with the first row."""
    q = 1.0 - alpha
    age = F.col("back") - 1
    return F.when(seed, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(q), age)


def _smoothed_weight(alpha: float, beta: float, seed: Column) -> Column:
    """Weight of a row in the ``beta`` average of the ``alpha`` average of the closes.

    The convolution of the two geometric weights has a closed form; the very first value of the
    smoothed series is zero (both inner averages start equal), which removes the seed's last term.
    """
    qa, qb = 1.0 - alpha, 1.0 - beta
    age = F.col("back") - 1
    later = alpha * beta / (qb - qa) * (F.pow(F.lit(qb), age + 1) - F.pow(F.lit(qa), age + 1))
    first = beta * qa / (qb - qa) * (F.pow(F.lit(qb), age) - F.pow(F.lit(qa), age))
    return F.when(seed, first).otherwise(later)


def signals(prices: DataFrame) -> DataFrame:
    """All ten raw signals and the three moving-average flags, one row per symbol.

    Each signal needs a minimum number of rows and is null below it.
    """
    c, prev, v, ret = F.col("c"), F.col("prev"), F.col("v"), F.col("ret")
    change = c - prev
    true_range = F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - prev), F.abs(F.col("l") - prev))
    seed = F.col("rn") == 1
    fast, slow, smooth = 2 / 13, 2 / 27, 2 / 10
    macd_line = F.sum(c * (_ema_weight(fast, seed) - _ema_weight(slow, seed)))
    signal_line = F.sum(c * (_smoothed_weight(fast, smooth, seed) - _smoothed_weight(slow, smooth, seed)))
    # The slope does not depend on where the running volume starts, so the last 20 steps suffice:
    # step i of them enters every later value of the 20-row line.
    step = F.signum(F.coalesce(change, F.lit(0.0))) * v
    # Least squares over x = 0..19: slope = sum((x - 9.5) * y) / 665, with y the running sum of steps.
    lead = F.col("back") - 1  # 0 for the newest row
    x_tail = lead + 1  # number of line points at or after this step
    centered = x_tail * (F.lit(19.0) + (F.lit(20.0) - x_tail)) / 2.0 - 9.5 * x_tail
    obv_slope = F.sum(F.when(F.col("back") <= 19, step * centered)) / 665.0

    stats = numbered(prices).groupBy("symbol").agg(
        F.count("*").alias("n"), F.max("price_date").alias("last_date"), _at(1).alias("close"),
        _at(21).alias("c21"), _at(252).alias("c252"),
        F.avg(_tail(F.greatest(change, F.lit(0.0)), 14)).alias("gain"),
        F.avg(_tail(F.greatest(-change, F.lit(0.0)), 14)).alias("loss"),
        *[F.avg(_tail(c, k)).alias(f"sma{k}") for k in (20, 50, 100, 200)],
        F.stddev_samp(_tail(c, 20)).alias("sd20"),
        F.stddev_samp(_tail(ret, 20)).alias("vol"),
        F.avg(_tail(v, 20)).alias("v20"), F.avg(_tail(v, 50)).alias("v50"),
        F.avg(_tail(true_range, 14)).alias("atr"),
        (macd_line - signal_line).alias("histogram"),
        obv_slope.alias("slope"),
    )
    n, close = F.col("n"), F.col("close")
    enough = lambda k, value: F.when(n >= k, value)
    rs = safe_div(F.col("gain"), F.col("loss"))
    dist = lambda k: (close - F.col(f"sma{k}")) / F.col(f"sma{k}")
    cross = F.when(F.col("sma50") > F.col("sma200"), 1.0).otherwise(-1.0)
    band = F.col("sd20") * 4.0
    return stats.select(
        "symbol", "n", "last_date", "close",
        enough(252, F.col("c21") / F.col("c252") - 1).alias("momentum_12_1"),
        enough(15, 100.0 - 100.0 / (1.0 + rs)).alias("rsi_14"),
        F.when(n >= 200, dist(200) * 0.5 + dist(50) * 0.3 + cross * 0.2).when(n >= 50, dist(50)).alias("sma_trend"),
        enough(21, F.col("vol") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("realized_vol_20"),
        enough(50, safe_div(F.col("v20"), positive(F.col("v50")))).alias("volume_trend"),
        enough(35, safe_div(F.col("histogram"), positive(close))).alias("macd"),
        enough(20, safe_div(close - (F.col("sma20") - F.col("sd20") * 2.0), positive(band))).alias("bollinger_pctb"),
        enough(15, safe_div(F.col("atr"), positive(close))).alias("atr_pct"),
        enough(21, safe_div(F.col("slope"), positive(F.col("v20")))).alias("obv_trend"),
        enough(21, close / F.col("c21") - 1).alias("roc_20"),
        *[enough(k, close >= F.col(f"sma{k}")).alias(f"above_sma{k}") for k in (50, 100, 200)],
    )


def realized_volatility(prices: DataFrame, window: int = 20) -> DataFrame:
    """Annualized volatility of the last ``window`` log returns; symbols with fewer rows get null."""
    return numbered(prices).groupBy("symbol").agg(
        F.when(
            F.count("*") >= window + 1,
            F.stddev_samp(_tail(F.col("ret"), window)) * F.sqrt(F.lit(float(TRADING_DAYS))),
        ).alias("realized_vol")
    )


def scores(raw: DataFrame) -> DataFrame:
    """Scores next to the raw signals, as <signal>_score."""
    return raw.withColumns({f"{s}_score": rounded_score(s, F.col(s)) for s in SIGNALS})


def composites(scored: DataFrame) -> DataFrame:
    """One row per symbol and preset: all presets come from a single pass over the scores."""
    columns = {s: F.col(f"{s}_score") for s in SIGNALS}
    per_preset = F.array(*[
        F.struct(F.lit(p).alias("preset"), composite(columns, p).alias("composite")) for p in PRESET_WEIGHTS
    ])
    return (
        scored.withColumn("p", F.explode(per_preset))
        .withColumns({"preset": F.col("p.preset"), "composite": F.col("p.composite")})
        .drop("p")
    )


def ranking(prices: DataFrame) -> DataFrame:
    """Signals, scores, composite, band and rank per preset for symbols with enough rows."""
    scored = composites(scores(signals(prices).where(F.col("n") >= MIN_ROWS)))
    return rank_by_score(scored, "composite", "symbol", "rank", groups=["preset"]).withColumn(
        "band", score_band(F.col("composite"))
    )


def indicator_series(prices: DataFrame) -> DataFrame:
    """Per-day indicator lines; rolling values are null until their frame is full."""
    by_date = Window.partitionBy("symbol").orderBy("price_date")
    frame = lambda k: by_date.rowsBetween(-(k - 1), 0)
    full = lambda k, value: F.when(F.col("rn") >= k, value)
    base = (
        numbered(prices).drop("back", "ret")
        .withColumns({
            **{f"sma{k}": full(k, F.avg("c").over(frame(k))) for k in (20, 50, 200)},
            "sd20": full(20, F.stddev_samp("c").over(frame(20))),
            "obv": F.sum(F.signum(F.coalesce(F.col("c") - F.col("prev"), F.lit(0.0))) * F.col("v")).over(
                by_date.rowsBetween(Window.unboundedPreceding, 0)
            ),
        })
        .withColumns({
            "boll_upper": F.col("sma20") + F.col("sd20") * 2.0,
            "boll_lower": F.col("sma20") - F.col("sd20") * 2.0,
        })
    )
    fast = exponential_average(base, "symbol", "price_date", "c", 12, "ema12", "rn")
    slow = exponential_average(fast, "symbol", "price_date", "c", 26, "ema26", "rn")
    line = slow.withColumn("macd", F.col("ema12") - F.col("ema26"))
    return exponential_average(line, "symbol", "price_date", "macd", 9, "macd_signal", "rn").select(
        "symbol", "price_date", "sma50", "sma200", "ema12", "ema26", "macd", "macd_signal",
        "sma20", "boll_upper", "boll_lower", "obv",
    )
