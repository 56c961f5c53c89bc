"""Roll-forward reconciliation of snapshots through trades, for all accounts and pairs in one job.

Trades are first netted per (account, holding, day) — a partial aggregation that shrinks any hot
holding before the shuffle — and only the days are matched with snapshot pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.instruments import is_option, position_key, signed_quantity
from folioforge.operators.holdings import dedup_positions, snapshot_dates
from folioforge.operators.keyed import first_per_key
from folioforge.operators.lineage import written_once
from folioforge.operators.scans import in_segments, segment_scan
from folioforge.operators.trades import dedup_trades, with_account
from folioforge.schemas import POSITION_KEY

PAIR = ["account_id", "base_date", "target_date"]
_HOLDING = ["account_id", *POSITION_KEY]


def snapshot_pairs(positions: DataFrame, statements: DataFrame) -> DataFrame:
    """Consecutive snapshot dates of each account."""
    w = Window.partitionBy("account_id").orderBy("statement_date")
    return (
        snapshot_dates(positions, statements)
        .select("account_id", F.col("statement_date").alias("base_date"), F.lead("statement_date").over(w).alias("target_date"))
        .where(F.col("target_date").isNotNull())
    )


def latest_pairs(pairs: DataFrame) -> DataFrame:
    """The newest pair of each account."""
    return first_per_key(pairs, ["account_id"], [F.col("target_date").desc()])


def _in_pair(days: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows with a day joined to every pair that includes it.

    A day belongs to the pair with base < day <= target. Trades after midnight of a base date also
    count in the pair that starts there, because the lower bound is that midnight. Pairs are listed
    per month they touch, so this is an equi-join on (account, month) with few candidates per row.
    """
    monthly = pairs.withColumn(
        "month", F.explode(F.sequence(F.trunc("base_date", "month"), F.trunc("target_date", "month"), F.expr("interval 1 month")))
    )
    day = F.col("day")
    return (
        days.withColumn("month", F.trunc("day", "month")).join(monthly, ["account_id", "month"])
        .where(((day > F.col("base_date")) | (F.col("intraday") & (day == F.col("base_date")))) & (day <= F.col("target_date")))
        .drop("month")
    )


def _dated(trades: DataFrame) -> DataFrame:
    """Trades with holding key, day and whether they fall after midnight."""
    symbol, *terms = position_key()
    day = F.to_date("trade_date")
    return trades.select(
        "account_id", symbol, *terms, "asset_class", "side", "quantity", "price", "trade_date",
        day.alias("day"), (F.col("trade_date") > day.cast("timestamp_ntz")).alias("intraday"),
        signed_quantity().alias("signed"),
    )


def paired_trades(trades: DataFrame, positions: DataFrame, statements: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Deduplicated trades of every pair (a trade on a base date may appear in two pairs)."""
    pairs = snapshot_pairs(positions, statements) if pairs is None else pairs
    dated = _dated(dedup_trades(with_account(trades, statements)))
    return _in_pair(dated, pairs)


def reconcile(trades: DataFrame, positions: DataFrame, statements: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per pair and holding: base, traded, reconstructed and expected quantity, match and gap class.

    ``suppressed`` marks expired options without a long quantity on either side; they are not
    judged. ``gap`` is missing_from_target, missing_from_reconstruction or null.
    """
    pairs = snapshot_pairs(positions, statements) if pairs is None else pairs
    held = dedup_positions(positions, statements)
    symbol, *terms = position_key()
    held = held.select("account_id", symbol, *terms, "asset_class", "quantity", "statement_date")

    dated = _dated(dedup_trades(with_account(trades, statements)))
    netted = dated.groupBy("account_id", *POSITION_KEY, "asset_class", "day", "intraday").agg(
        F.sum("signed").alias("net"), F.count("*").alias("n")
    )
    moves = _in_pair(netted, pairs).select(
        *PAIR, *POSITION_KEY, "asset_class", F.lit("move").alias("part"), F.col("net").alias("qty"), "n",
    )
    # Each snapshot row is the target of the pair that ends there and the base of the next one.
    roles = pairs.select("account_id", "base_date", "target_date", F.explode(F.array(
        F.struct(F.lit("base").alias("part"), F.col("base_date").alias("statement_date")),
        F.struct(F.lit("target").alias("part"), F.col("target_date").alias("statement_date")),
    )).alias("r")).select(*PAIR, "r.part", "r.statement_date")
    snapshots = held.join(roles, ["account_id", "statement_date"]).select(
        *PAIR, *POSITION_KEY, "asset_class", "part", F.col("quantity").alias("qty"), F.lit(0).cast("long").alias("n"),
    )
    # The full outer match of the three sides is one aggregation over their union: an absent side
    # contributes nothing, and null option terms group together.
    zero = F.lit(0)
    part = F.col("part")
    side_sum = lambda p: F.coalesce(F.sum(F.when(part == p, F.col("qty"))), zero)
    merged = (
        moves.unionByName(snapshots)
        .groupBy(*PAIR, *POSITION_KEY)
        .agg(
            F.min("asset_class").alias("asset_class"),
            side_sum("base").alias("base_qty"), side_sum("move").alias("traded_qty"),
            F.sum("n").alias("trades"), side_sum("target").alias("expected_qty"),
            F.bool_or(part == "target").alias("in_target"),
        )
        .withColumn("reconstructed_qty", F.col("base_qty") + F.col("traded_qty"))
    )
    rec, exp = F.col("reconstructed_qty"), F.col("expected_qty")
    return merged.withColumns({
        "diff": rec - exp,
        "match": rec == exp,
        "suppressed": F.coalesce(is_option() & (F.col("expiry") < F.col("target_date")) & (rec <= 0) & (exp <= 0), F.lit(False)),
        "gap": F.when(~F.col("in_target") & (rec > 0), "missing_from_target")
        .when(F.col("in_target") & (rec <= 0) & (exp > 0), "missing_from_reconstruction"),
    })


def judged(result: DataFrame) -> DataFrame:
    """Holdings that count: everything but suppressed expired options."""
    return result.where(~F.col("suppressed"))


def pair_summary(result: DataFrame) -> DataFrame:
    """Per pair: holdings, mismatches, gaps and whether everything matches."""
    return judged(result).groupBy(*PAIR).agg(
        F.count("*").alias("holdings"),
        F.count_if(~F.col("match")).alias("mismatches"),
        F.count_if(F.col("gap") == "missing_from_target").alias("missing_from_target"),
        F.count_if(F.col("gap") == "missing_from_reconstruction").alias("missing_from_reconstruction"),
        F.bool_and("match").alias("ok"),
    )


def ledger(trades: DataFrame, positions: DataFrame, statements: DataFrame) -> DataFrame:
    """Every trade of every pair with the running quantity of its holding.

    Holdings are keyed without nulls (absent option terms get a stand-in), so joins and scans share plain keys. The trades
    are cut into segments of a bounded size once; a holding with most trades of a day spreads over many.
    """
    # Written, so that the trades which meet them know how few they are and need not be sent.
    pairs = written_once(snapshot_pairs(positions, statements))
    moves = paired_trades(trades, positions, statements, pairs)
    symbol, *terms = position_key()
    base = dedup_positions(positions, statements).select(
        "account_id", F.col("statement_date").alias("base_date"), _holding(symbol, *terms), F.col("quantity").alias("base_qty"))
    keyed = moves.withColumn("__holding", _holding(*[F.col(c) for c in POSITION_KEY]))
    opened = keyed.join(base, ["account_id", "base_date", "__holding"], "left").withColumn("base_qty", F.coalesce("base_qty", F.lit(0)))
    keys = [*PAIR, "__holding"]
    placed = in_segments(opened, [*keys, "day", "trade_date", "side", "quantity", "price"])
    order = F.struct("day", "trade_date", "side", "quantity", "price")
    scanned = segment_scan(placed.withColumn("__order", order), keys, "__order", sums={"running_qty": F.col("signed")})
    return scanned.withColumn("running_qty", F.col("base_qty") + F.col("running_qty")).drop("__holding", "__order", "part", "seg")


def _holding(symbol: Column, expiry: Column, strike: Column, right: Column) -> Column:
    """One text per holding; absent terms differ from every term that can occur."""
    texts = [F.coalesce(c.cast("string"), F.lit("-")) for c in (symbol, expiry, strike, right)]
    return F.concat_ws("|", *texts).alias("__holding")
