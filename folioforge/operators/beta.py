"""Betas against benchmarks and beta-weighted exposure of portfolios with options."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.instruments import (
    DAYS_PER_YEAR, DEFAULT_VOLATILITY, is_option, option_beta, option_delta, underlying,
)
from folioforge.functions.numeric import as_double, positive, safe_div
from folioforge.operators.prices import lookback
from folioforge.operators.technical import realized_volatility

# Window and minimum number of common rows.
LOOKBACK_ROWS = 252
MIN_PERIODS = 60


def betas(
    prices: DataFrame, benchmarks: DataFrame, lookback_rows: int = LOOKBACK_ROWS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """Beta of every symbol against every benchmark series; null where the data does not suffice.

    Every pair has a row, also one without a common day.

    Rows are matched by day first, then cut to the newest ones, then differenced, so the returns of
    both sides always span the same days. The benchmark side has one row per day and benchmark; it
    is broadcast only if its measured size allows.
    """
    bench = benchmarks.select(
        F.col("symbol").alias("benchmark"), "price_date", as_double("adj_close").alias("b")
    )
    joined = prices.select("symbol", "price_date", as_double("adj_close").alias("s")).join(bench, "price_date")
    pair = ["symbol", "benchmark"]
    newest = Window.partitionBy(*pair).orderBy(F.col("price_date").desc())
    by_date = Window.partitionBy(*pair).orderBy("price_date")
    returns = (
        joined.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= lookback_rows)
        .withColumn("rs", F.ln(F.col("s") / F.lag("s").over(by_date)))
        .withColumn("rb", F.ln(F.col("b") / F.lag("b").over(by_date)))
    )
    both = F.col("rs").isNotNull() & F.col("rb").isNotNull()
    rb, rs = F.when(both, F.col("rb")), F.when(both, F.col("rs"))
    stats = returns.groupBy(*pair).agg(
        F.count("*").alias("rows"), F.count_if(both).alias("returns"),
        F.var_samp(rb).alias("bench_var"), F.covar_samp(rs, rb).alias("cov"),
    )
    ok = (F.col("rows") >= min_periods) & (F.col("returns") >= min_periods - 1)
    # The handful of benchmark names comes from a scalar subquery, so no cross join is planned.
    names = benchmarks.agg(F.collect_set("symbol").alias("names")).scalar()
    pairs = prices.select("symbol").distinct().withColumn("benchmark", F.explode(names))
    return pairs.join(stats, pair, "left").select(
        *pair, F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(ok, safe_div(F.col("cov"), F.col("bench_var"))).alias("beta"),
    )


def per_benchmark(rows: DataFrame, benchmarks: list[str]) -> DataFrame:
    """Each row once per benchmark."""
    return rows.withColumn("benchmark", F.explode(F.array(*[F.lit(b) for b in benchmarks])))


def override_missing(computed: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual betas (symbol, manual_beta) fill only the nulls."""
    return computed.join(manual, "symbol", "left").withColumn(
        "beta", F.coalesce("beta", "manual_beta")
    ).drop("manual_beta")


def dollar_betas(values: DataFrame, beta: DataFrame, benchmarks: list[str]) -> DataFrame:
    """Value per underlying and benchmark with its beta (null if unknown), plus beta times value."""
    known = beta.withColumnRenamed("symbol", "underlying")
    return per_benchmark(values, benchmarks).join(known, ["underlying", "benchmark"], "left").withColumn(
        "dollar_beta", F.col("beta") * as_double("market_value")
    )


def portfolio_beta(exposure: DataFrame, scope: tuple[str, ...] = ("account_id", "benchmark")) -> DataFrame:
    """Value-weighted beta over rows that have one, and the total dollar beta."""
    known = F.col("beta").isNotNull()
    value = as_double("market_value")
    return exposure.groupBy(*scope).agg(
        safe_div(
            F.sum(F.when(known, F.col("beta") * value)), positive(F.sum(F.when(known, value)))
        ).alias("portfolio_beta"),
        F.coalesce(F.sum("dollar_beta"), F.lit(0.0)).alias("portfolio_dollar_beta"),
        F.count_if(known).alias("with_beta"), F.count_if(~known).alias("without_beta"),
    )


def spot_prices(positions: DataFrame, prices: DataFrame, as_of: date, days: int = 10) -> DataFrame:
    """Price of each (account, underlying): the held share's market price, else the last recent close."""
    held = (
        positions.where(F.col("asset_class").isin("STK", "ETF"))
        .groupBy("account_id", F.col("symbol").alias("underlying"))
        .agg(F.max("market_price").alias("held_price"))
    )
    recent = lookback(prices, as_of, days).groupBy(F.col("symbol").alias("underlying")).agg(
        F.max_by("close", "price_date").alias("last_close")
    )
    wanted = positions.select("account_id", underlying().alias("underlying")).distinct()
    return (
        wanted.join(held, ["account_id", "underlying"], "left").join(recent, "underlying", "left")
        .select(
            "account_id", "underlying",
            F.coalesce(positive(as_double("held_price")), positive(as_double("last_close"))).alias("spot"),
        )
    )


def option_greeks(
    positions: DataFrame, prices: DataFrame, beta: DataFrame, benchmarks: list[str], as_of: date,
    price_days: int = 10, vol_days: int = 60, min_option_price: float | None = None,
) -> DataFrame:
    """Delta and option beta of every option row, one row per (position, benchmark).

    Volatility is the realized one over ``vol_days`` when it exists and is positive, else the default.
    ``min_option_price`` floors the option price for the detail view.
    """
    spots = spot_prices(positions, prices, as_of, price_days)
    vols = realized_volatility(lookback(prices, as_of, vol_days)).withColumnRenamed("symbol", "underlying")
    price = F.abs(as_double("market_price"))
    if min_option_price is not None:
        price = F.greatest(price, F.lit(min_option_price))
    rows = (
        positions.where(is_option()).withColumn("underlying", underlying())
        .join(spots, ["account_id", "underlying"], "left")
        .join(vols, "underlying", "left")
        .withColumns({
            "sigma": F.coalesce(positive(F.col("realized_vol")), F.lit(DEFAULT_VOLATILITY)),
            "years": F.greatest(F.datediff("expiry", F.lit(as_of)), F.lit(0)) / F.lit(DAYS_PER_YEAR),
            "option_price": price,
        })
        .withColumn("delta", option_delta(F.col("spot"), F.col("strike"), F.col("years"), F.col("sigma"), F.col("right")))
    )
    known = beta.select(F.col("symbol").alias("underlying"), "benchmark", F.col("beta").alias("underlying_beta"))
    return (
        per_benchmark(rows, benchmarks).join(known, ["underlying", "benchmark"], "left")
        .withColumn("option_beta", option_beta(F.col("underlying_beta"), F.col("spot"), F.col("option_price"), F.col("delta")))
    )


def effective_betas(
    positions: DataFrame, prices: DataFrame, beta: DataFrame, benchmarks: list[str], as_of: date, **windows: int
) -> DataFrame:
    """Per position and benchmark: share beta on the unsigned value, option beta on the signed value."""
    shares = (
        per_benchmark(positions.where(F.col("asset_class").isin("STK", "ETF")), benchmarks)
        .join(beta.select("symbol", "benchmark", "beta"), ["symbol", "benchmark"], "left")
        .select(
            "account_id", "symbol", "asset_class", "benchmark", F.col("beta").alias("effective_beta"),
            F.coalesce(F.abs(as_double("market_value")), F.lit(0.0)).alias("weight_value"),
        )
    )
    options = option_greeks(positions, prices, beta, benchmarks, as_of, **windows).select(
        "account_id", "symbol", "asset_class", "benchmark", F.col("option_beta").alias("effective_beta"),
        F.coalesce(as_double("market_value"), F.lit(0.0)).alias("weight_value"),
    )
    return shares.unionByName(options).withColumn(
        "dollar_beta", F.when(F.col("weight_value") != 0, F.col("effective_beta") * F.col("weight_value"))
    )


def option_adjusted_beta(effective: DataFrame) -> DataFrame:
    """Portfolio beta with options: signed dollar beta over unsigned value of rows that have a beta."""
    known = F.col("effective_beta").isNotNull()
    contribution = F.col("effective_beta") * F.col("weight_value")
    return effective.groupBy("account_id", "benchmark").agg(
        safe_div(
            F.sum(F.when(known, contribution)), positive(F.sum(F.when(known, F.abs("weight_value"))))
        ).alias("portfolio_beta"),
        F.coalesce(F.sum(F.when(known, contribution)), F.lit(0.0)).alias("portfolio_dollar_beta"),
    )
