"""Trade selection, deduplication and realized P&L statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.instruments import first_token
from folioforge.functions.numeric import as_double
from folioforge.operators.keyed import first_per_key, null_safe_join
from folioforge.schemas import TRADE_FINGERPRINT


def with_account(children: DataFrame, statements: DataFrame, *extra: str) -> DataFrame:
    """Attach account_id (and other statement columns) to positions or trades.

    Children written by this package already carry these columns; then no join is planned.
    """
    if all(c in children.columns for c in ("account_id", *extra)):
        return children
    children = children.drop("account_id", *extra)
    header = statements.select(F.col("id").alias("statement_id"), "account_id", *extra)
    return children.join(header, "statement_id")


def of_account(children: DataFrame, statements: DataFrame, account_id: str) -> DataFrame:
    """Children of one account's statements (semi join)."""
    ids = statements.where(F.col("account_id") == account_id).select(F.col("id").alias("statement_id"))
    return children.join(ids, "statement_id", "left_semi")


def _day_end(day: date | Column) -> Column:
    return (F.lit(day) if isinstance(day, date) else day).cast("timestamp_ntz") + F.expr("interval '23:59:59' hour to second")


def filter_trades(
    trades: DataFrame, statements: DataFrame | None = None, *, statement_id: str | None = None,
    account_id: str | None = None, symbol: str | None = None, asset_class: str | None = None,
    side: str | None = None, date_from: date | None = None, date_to: date | None = None,
) -> DataFrame:
    """Conjunction of the given filters; a statement id takes precedence over an account."""
    out = trades
    if statement_id:
        out = out.where(F.col("statement_id") == statement_id)
    elif account_id:
        if statements is None:
            raise ValueError("an account filter needs the statements table")
        out = of_account(out, statements, account_id)
    if symbol:
        out = out.where(F.col("symbol") == symbol)
    if asset_class:
        out = out.where(F.col("asset_class") == asset_class)
    if side:
        out = out.where(F.col("side") == side)
    if date_from:
        out = out.where(F.col("trade_date") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        out = out.where(F.col("trade_date") <= _day_end(date_to))
    return out


def dedup_trades(trades: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """One row per trade fingerprint and key; the smallest statement id stands for the copies."""
    return first_per_key(trades, [*keys, *TRADE_FINGERPRINT], [F.col("statement_id")])


def trades_between(
    trades: DataFrame, statements: DataFrame, after: date, up_to: date,
    exclude_base_day: bool = False,
) -> DataFrame:
    """Deduplicated trades after one date up to the end of another, for all accounts.

    The lower bound is midnight of ``after``, so later trades of that day are included unless
    ``exclude_base_day`` is set.
    """
    low = _day_end(after) if exclude_base_day else F.lit(after).cast("timestamp_ntz")
    chosen = trades.where((F.col("trade_date") > low) & (F.col("trade_date") <= _day_end(up_to)))
    return dedup_trades(with_account(chosen, statements))


def duplicate_counts(incoming: DataFrame, stored: DataFrame, statements: DataFrame, positions: DataFrame) -> DataFrame:
    """Per incoming statement: new and duplicate trades against the other statements of the account.

    ``incoming`` and ``stored`` are trades tables; ``positions`` are the incoming positions (always new).
    Copies are counted per fingerprint before the join, so a heavily repeated trade is one row there.
    """
    mine = (
        with_account(incoming, statements)
        .groupBy("account_id", "statement_id", *TRADE_FINGERPRINT).agg(F.count("*").alias("copies"))
    )
    # A fingerprint is known when another statement has it: two different holders, or one that is not us.
    holders = (
        with_account(stored, statements)
        .groupBy("account_id", *TRADE_FINGERPRINT)
        .agg(F.min("statement_id").alias("first_holder"), F.max("statement_id").alias("last_holder"))
    )
    known = (F.col("first_holder") != F.col("statement_id")) | (F.col("last_holder") != F.col("statement_id"))
    counted = (
        null_safe_join(mine, holders, ["account_id", *TRADE_FINGERPRINT], "left")
        .groupBy("statement_id")
        .agg(
            F.sum(F.when(known, F.col("copies")).otherwise(0)).alias("dup_trades"),
            F.sum(F.when(known, 0).otherwise(F.col("copies"))).alias("new_trades"),
        )
    )
    placed = positions.groupBy("statement_id").agg(F.count("*").alias("new_positions"))
    return counted.join(placed, "statement_id", "full_outer").select(
        "statement_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("new_trades", "dup_trades", "new_positions")],
        F.lit(0).cast("long").alias("dup_positions"),
    )


def closing(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("realized_pnl") != 0)


def trade_totals(trades: DataFrame) -> DataFrame:
    return trades.agg(
        F.sum("realized_pnl").alias("total_realized"),
        F.sum("commission").alias("total_commission"),
        F.count("*").alias("trades"),
    )


def daily_pnl(trades: DataFrame) -> DataFrame:
    return (
        trades.where(F.col("trade_date").isNotNull())
        .groupBy(F.to_date("trade_date").alias("trade_day"))
        .agg(F.sum("realized_pnl").alias("realized_pnl"))
    )


def cumulative_pnl(trades: DataFrame) -> DataFrame:
    """Running P&L over days. The window sees one row per calendar day, whatever the trade count."""
    w = Window.orderBy("trade_day").rowsBetween(Window.unboundedPreceding, 0)
    return daily_pnl(trades).withColumn("cumulative_pnl", F.sum("realized_pnl").over(w))


def pnl_by_symbol(trades: DataFrame) -> DataFrame:
    """Closing-trade statistics per underlying."""
    won = F.count_if(F.col("realized_pnl") > 0)
    n = F.count("*")
    return (
        closing(trades).groupBy(first_token().alias("symbol"))
        .agg(
            F.sum("realized_pnl").alias("total_pnl"), n.alias("trades"), won.alias("wins"),
            (as_double(F.sum("realized_pnl")) / n).alias("avg_pnl"),
            F.sum("commission").alias("total_commission"),
            F.bround(won / n * 100, 1).alias("win_rate"),
        )
        .orderBy(F.col("total_pnl").desc(), "symbol")
    )


def win_loss_stats(trades: DataFrame) -> DataFrame:
    """Win rate, averages, profit factor and extremes over closing trades, in one pass."""
    pnl = F.col("realized_pnl")
    win, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    base = trades.agg(
        F.count_if(pnl != 0).alias("closing_trades"), F.count_if(pnl > 0).alias("winners"),
        F.count_if(pnl < 0).alias("losers"),
        F.coalesce(as_double(F.sum(win)), F.lit(0.0)).alias("gross_wins"),
        F.coalesce(F.abs(as_double(F.sum(loss))), F.lit(0.0)).alias("gross_losses"),
        F.coalesce(as_double(F.max(win)), F.lit(0.0)).alias("largest_win"),
        F.coalesce(as_double(F.min(loss)), F.lit(0.0)).alias("largest_loss"),
        F.abs(as_double(F.sum("commission"))).alias("commissions"),
    )
    gw, gl = F.col("gross_wins"), F.col("gross_losses")
    return base.where(F.col("closing_trades") > 0).select(
        "closing_trades", "winners", "losers",
        (F.col("winners") / F.col("closing_trades") * 100).alias("win_rate"),
        F.coalesce(F.try_divide(gw, F.col("winners")), F.lit(0.0)).alias("avg_win"),
        F.coalesce(-F.try_divide(gl, F.col("losers")), F.lit(0.0)).alias("avg_loss"),
        "gross_wins", "gross_losses",
        F.when(gl > 0, gw / gl).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        "largest_win", "largest_loss",
        F.when(gw > 0, F.col("commissions") / gw * 100).otherwise(F.lit(0.0)).alias("commission_pct"),
    )


def pnl_histogram(trades: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width, right-closed bins over closing trades; empty bins are kept."""
    values = closing(trades).select(as_double("realized_pnl").alias("v"))
    # One scalar subquery yields both bounds; its two uses are planned once.
    bounds = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("bounds")).scalar()
    spread = lambda df: df.withColumn("bounds", bounds).withColumns({"lo": F.col("bounds.lo"), "hi": F.col("bounds.hi")})
    placed = spread(values).select(
        F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2))
        .otherwise(F.greatest(F.lit(1), F.ceil((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int")))
        .alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    all_bins = trades.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (
        spread(all_bins.join(counts, "bin", "left"))
        .select(
            F.col("bin").cast("long").alias("bin"),
            (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") - 1) / bins).alias("bin_low"),
            (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("bin_high"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def top_symbols(stats: DataFrame, measure: str, k: int = 10) -> DataFrame:
    """Top-k report; planned as take-ordered per task, then merge."""
    return stats.orderBy(F.col(measure).desc_nulls_last(), "symbol").limit(k)


def date_presets(as_of: date) -> dict[str, date | None]:
    """Named start dates relative to an as-of date."""
    from datetime import timedelta

    # Preset -> days back.
    days = {"1W": 7, "1M": 30, "3M": 90, "1Y": 365}
    out: dict[str, date | None] = {name: as_of - timedelta(days=n) for name, n in days.items()}
    out["YTD"] = date(as_of.year, 1, 1)
    out["All"] = None
    return out


def totals_by_preset(trades: DataFrame, as_of: date) -> DataFrame:
    """Trade totals for every named date range in one scan (a trade may fall in several ranges).

    A range without a start holds every trade, also later and undated ones.
    """
    ranges = F.array(*[
        F.struct(F.lit(name).alias("preset"), F.lit(start and start.isoformat()).cast("date").alias("start"))
        for name, start in date_presets(as_of).items()
    ])
    day = F.to_date("trade_date")
    matching = F.filter(ranges, lambda r: r["start"].isNull() | ((r["start"] <= day) & (day <= F.lit(as_of))))
    return (
        trades.select(F.explode(F.transform(matching, lambda r: r["preset"])).alias("preset"), "realized_pnl", "commission")
        .groupBy("preset")
        .agg(
            F.sum("realized_pnl").alias("total_realized"), F.sum("commission").alias("total_commission"),
            F.count("*").alias("trades"),
        )
    )
