"""Daily bars: normalization, lookups, coverage and freshness."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.keyed import latest_value

_BAR = ["open", "high", "low", "close", "adj_close", "volume"]


def normalize_prices(raw: DataFrame) -> DataFrame:
    """Landed bars in table form: upper-case symbol, 4-decimal prices, close as default adj_close.

    Values that do not parse become null, so that the quality rules can quarantine the row.
    """
    price = lambda c: F.round(F.col(c).try_cast("decimal(38,10)"), 4)
    columns = {c: price(c) for c in ("open", "high", "low", "close")}
    adjusted = price("adj_close") if "adj_close" in raw.columns else F.lit(None).cast("decimal(38,4)")
    return raw.select(
        F.upper(F.trim("symbol")).alias("symbol"),
        F.col("price_date").try_cast("date").alias("price_date"),
        *[c.alias(n) for n, c in columns.items()],
        F.coalesce(adjusted, columns["close"]).alias("adj_close"),
        F.col("volume").try_cast("double").cast("long").alias("volume"),
    )


def price_range(prices: DataFrame, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """Bars between two dates, both inclusive."""
    out = prices
    if date_from:
        out = out.where(F.col("price_date") >= F.lit(date_from))
    if date_to:
        out = out.where(F.col("price_date") <= F.lit(date_to))
    return out


def lookback(prices: DataFrame, as_of: date, days: int) -> DataFrame:
    """Bars of the last ``days`` calendar days before (and including) the as-of date."""
    return prices.where(
        (F.col("price_date") >= F.date_sub(F.lit(as_of), days)) & (F.col("price_date") <= F.lit(as_of))
    )


def latest_prices(prices: DataFrame) -> DataFrame:
    """Newest bar per symbol."""
    return latest_value(prices, ["symbol"], _BAR, "price_date")


def coverage(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(
        F.min("price_date").alias("first_date"), F.max("price_date").alias("last_date"), F.count("*").alias("days")
    )


def missing_ranges(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Date ranges still to load: before the first and after the last stored day.

    ``requests`` has symbol, start and end; a symbol without bars needs its whole range.
    """
    stored = coverage(prices)
    gap = lambda lo, hi: F.struct(lo.alias("gap_start"), hi.alias("gap_end"))
    start, end = F.col("start"), F.col("end")
    first, last = F.col("first_date"), F.col("last_date")
    gaps = F.when(first.isNull(), F.array(gap(start, end))).otherwise(
        F.filter(
            F.array(gap(start, F.date_sub(first, 1)), gap(F.date_add(last, 1), end)),
            lambda g: g["gap_start"] <= g["gap_end"],
        )
    )
    return (
        requests.join(stored, "symbol", "left")
        .select("symbol", F.explode(gaps).alias("g"))
        .select("symbol", "g.gap_start", "g.gap_end")
    )


def age_band(days: Column) -> Column:
    # Thresholds in days.
    return F.when(days.isNull(), "none").when(days <= 1, "fresh").when(days <= 7, "aging").otherwise("stale")


def freshness(symbols: DataFrame, prices: DataFrame, as_of: date) -> DataFrame:
    """Newest bar, its age and age band for every requested symbol."""
    newest = prices.groupBy("symbol").agg(F.max("price_date").alias("last_date"))
    age = F.datediff(F.lit(as_of), F.col("last_date"))
    return symbols.select("symbol").distinct().join(newest, "symbol", "left").select(
        "symbol", "last_date", age.alias("age_days"), age_band(age).alias("band")
    )


def without_prices(symbols: DataFrame, prices: DataFrame) -> DataFrame:
    """Requested symbols that have no bar."""
    return symbols.select("symbol").distinct().join(prices.select("symbol").distinct(), "symbol", "left_anti")
