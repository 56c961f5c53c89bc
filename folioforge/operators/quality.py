"""Data-quality rules: each rule is a boolean column; rows that break one go to a quarantine relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.schemas import (
    ASSET_CLASSES, FLOW_METRICS, POINT_METRICS, RIGHTS, SIDES, VALUATION_PRESETS,
)


def _ok(condition: Column) -> Column:
    """A rule holds only when its condition is known to be true."""
    return F.coalesce(condition, F.lit(False))


def _option_terms() -> Column:
    complete = F.col("expiry").isNotNull() & F.col("strike").isNotNull() & F.col("right").isNotNull()
    return (F.col("asset_class") != "OPT") | complete


def _named(column: str) -> Column:
    return F.length(F.trim(column)) > 0


def position_rules() -> dict[str, Column]:
    return {
        "asset_class": _ok(F.col("asset_class").isin(ASSET_CLASSES)),
        "option_terms": _ok(_option_terms()),
        "right": F.col("right").isNull() | F.col("right").isin(RIGHTS),
    }


def trade_rules() -> dict[str, Column]:
    return {
        **position_rules(),
        "side": _ok(F.col("side").isin(SIDES)),
        "trade_date": F.col("trade_date").isNotNull(),
    }


def metric_rules() -> dict[str, Column]:
    return {
        "symbol": _ok(_named("symbol")),
        "metric_value": F.col("metric_value").isNotNull(),
        "period_end": F.col("period_end").isNotNull(),
        "cik": _ok((F.col("source") != "SEC_EDGAR") | _named("cik")),
    }


def price_rules() -> dict[str, Column]:
    bars = ["open", "high", "low", "close", "volume"]
    return {
        "symbol": _ok(_named("symbol")),
        "price_date": F.col("price_date").isNotNull(),
        **{c: F.col(c).isNotNull() & (F.col(c) > 0 if c != "volume" else F.lit(True)) for c in bars},
    }


def snapshot_rules() -> dict[str, Column]:
    return {"symbol": _ok(_named("symbol")), "preset": _ok(F.col("preset").isin(VALUATION_PRESETS))}


def clean_symbols(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", F.upper(F.trim("symbol")))


def clean_metrics(df: DataFrame) -> DataFrame:
    """Upper-case symbol, lower-case metric name, and a flag for names outside the known set."""
    return clean_symbols(df).withColumn("metric_name", F.lower(F.trim("metric_name"))).withColumn(
        "known_metric", F.col("metric_name").isin(FLOW_METRICS + POINT_METRICS)
    )


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("violations", broken)


def accept(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break no rule; no list of the broken ones is made for each row."""
    kept = F.lit(True)
    for ok in rules.values():
        kept = kept & F.coalesce(ok, F.lit(True))
    return df.where(kept)


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return with_violations(df, rules).where(F.size("violations") > 0)
