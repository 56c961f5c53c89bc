"""Positions and underlyings of every account with prices, signals, fundamentals, betas and greeks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.instruments import (
    DAYS_PER_YEAR, DEFAULT_VOLATILITY, OPTION_MULTIPLIER, breakeven, days_to_expiry, is_option, moneyness, option_beta,
    option_delta, underlying,
)
from folioforge.functions.numeric import as_double, drop_zero, safe_div
from folioforge.operators.beta import betas, dollar_betas
from folioforge.operators.fundamentals import latest_metrics
from folioforge.operators.holdings import value_by_underlying
from folioforge.operators.keyed import top_per_key
from folioforge.operators.prices import latest_prices, lookback
from folioforge.operators.technical import MIN_ROWS, realized_volatility, scores, signals

LOOKBACK_DAYS = 365
RECENT_TRADES = 20


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("symbol", "underlying")


def _wide_betas(rows: DataFrame, keys: list[str], benchmarks: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[
        F.max(F.when(F.col("benchmark") == b, F.col(c))).alias(f"{c}_{b.lower()}") for b in benchmarks for c in columns
    ])


def enriched_positions(
    positions: DataFrame, prices: DataFrame, today: date, benchmarks: list[str],
    vol_overrides: DataFrame | None = None, use_override: bool = False,
) -> DataFrame:
    """Latest positions with days to expiry, moneyness, breakeven, delta and option betas.

    ``positions`` are the deduplicated latest positions of all accounts. ``vol_overrides``
    (underlying, volatility_override) is shown beside the realized volatility; with ``use_override`` it also replaces
    it in the delta.
    """
    recent = lookback(prices, today, LOOKBACK_DAYS)
    close = _named(latest_prices(prices).select("symbol", as_double("close").alias("current_price")))
    vol = _named(realized_volatility(recent))
    beta = _named(_wide_betas(
        betas(recent.where(~F.col("symbol").isin(benchmarks)), recent.where(F.col("symbol").isin(benchmarks))),
        ["symbol"], benchmarks, ["beta"],
    ))
    rows = positions.withColumn("underlying", underlying()).join(close, "underlying", "left")
    rows = rows.join(vol, "underlying", "left").join(beta, "underlying", "left")
    sigma = drop_zero(F.col("realized_vol"))
    if vol_overrides is not None:
        rows = rows.join(vol_overrides, "underlying", "left")
        sigma = F.coalesce(F.col("volatility_override"), sigma) if use_override else sigma
    dte = days_to_expiry("expiry", today)
    delta = option_delta(
        F.col("current_price"), F.col("strike"), F.col("dte") / F.lit(DAYS_PER_YEAR), F.col("sigma"), F.col("right")
    )
    per_share = safe_div(F.abs(as_double("market_value")), F.abs(as_double("quantity")) * OPTION_MULTIPLIER)
    rows = rows.withColumns({
        "dte": dte, "sigma": F.coalesce(sigma, F.lit(DEFAULT_VOLATILITY)),
        "moneyness": moneyness(F.col("strike"), F.col("current_price"), F.col("right")),
        "breakeven": breakeven(F.col("strike"), drop_zero(F.col("cost_basis")), F.col("quantity"), F.col("right")),
    }).withColumn("delta", F.when(is_option() & F.col("right").isNotNull(), delta))
    return rows.withColumns({
        f"option_beta_{b.lower()}": F.when(
            is_option(), option_beta(F.col(f"beta_{b.lower()}"), F.col("current_price"), per_share, F.col("delta")))
        for b in benchmarks
    })


def underlying_context(
    positions: DataFrame, trades: DataFrame, prices: DataFrame, metrics: DataFrame, snapshots: DataFrame | None,
    today: date, benchmarks: list[str],
) -> DataFrame:
    """One row per (account, underlying): price, volatility, signals and scores, flags, latest
    fundamentals, latest snapshot, the newest trades, and betas with their dollar values."""
    recent = lookback(prices, today, LOOKBACK_DAYS)
    exposure = value_by_underlying(positions)
    close = _named(latest_prices(prices).select("symbol", as_double("close").alias("current_price")))
    technical = _named(scores(signals(recent).where(F.col("n") >= MIN_ROWS)).drop("close", "last_date", "n"))
    vol = _named(realized_volatility(recent))
    facts = latest_metrics(metrics).groupBy(F.col("symbol").alias("underlying")).agg(
        F.map_from_entries(F.collect_list(F.struct("metric_name", "metric_value"))).alias("fundamentals")
    )
    newest = top_per_key(
        trades.withColumn("underlying", underlying()), ["account_id", "underlying"],
        [F.col("trade_date").desc(), F.col("symbol"), F.col("side"), F.col("quantity"), F.col("price")], RECENT_TRADES,
    )
    listed = newest.groupBy("account_id", "underlying").agg(
        F.sort_array(F.collect_list(F.struct(
            "position", F.to_date("trade_date").alias("day"), "symbol", "side", "quantity", "price", "realized_pnl",
        ))).alias("recent_trades")
    )
    bench = betas(recent.where(~F.col("symbol").isin(benchmarks)), recent.where(F.col("symbol").isin(benchmarks)))
    wide = _wide_betas(dollar_betas(exposure, bench, benchmarks), ["account_id", "underlying"], benchmarks, ["beta", "dollar_beta"])
    out = exposure.join(listed, ["account_id", "underlying"], "left").join(wide, ["account_id", "underlying"], "left")
    for side in (close, vol, technical, facts):
        out = out.join(side, "underlying", "left")
    if snapshots is not None:
        renamed = _named(snapshots).select("underlying", F.struct(*[c for c in snapshots.columns if c != "symbol"]).alias("valuation"))
        out = out.join(renamed, "underlying", "left")
    return out
