"""Storing parsed statements: header upsert, child replacement, trade deduplication, cascade delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.keyed import delete_keys
from folioforge.operators.trades import with_account
from folioforge.schemas import TRADE_FINGERPRINT, TRADES

_FINGERPRINT = ["account_id", *TRADE_FINGERPRINT]


def _fingerprint() -> Column:
    """The identity of a trade as one value of fixed types. Missing parts are equal to each other in it."""
    types = {f.name: f.dataType for f in TRADES.fields}
    return F.struct(*[F.col(c).cast(types[c]).alias(c) for c in _FINGERPRINT])


def accepted_trades(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming trades that no other statement of the account has.

    Both sides carry account_id. ``stored`` excludes the statements being loaded. Among statements
    of one load the smallest id keeps a shared trade; repeated rows inside a statement all stay.
    Stored and incoming rows meet once, tagged, in one partial aggregation per fingerprint, whose exchange
    the join back to the incoming rows keeps.
    """
    tagged = incoming.select(_fingerprint().alias("fingerprint"), "statement_id", F.lit(False).alias("known")).unionByName(
        stored.select(_fingerprint().alias("fingerprint"), F.lit(None).cast("string").alias("statement_id"), F.lit(True).alias("known")))
    fresh = (
        tagged.groupBy("fingerprint").agg(F.min("statement_id").alias("holder"), F.bool_or("known").alias("known"))
        .where(~F.col("known")).drop("known")
    )
    return (
        incoming.withColumn("fingerprint", _fingerprint()).join(fresh, "fingerprint")
        .where(F.col("statement_id") == F.col("holder")).select(*incoming.columns)
    )


def replace_trades(stored: DataFrame, incoming: DataFrame, statements: DataFrame) -> DataFrame:
    """Trades table after loading the statements of ``incoming``."""
    loaded = incoming.select("statement_id").distinct()
    others = delete_keys(with_account(stored, statements), loaded, ["statement_id"])
    return others.unionByName(accepted_trades(with_account(incoming, statements), others))


def replace_positions(stored: DataFrame, incoming: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Positions table after loading; a statement's snapshot is replaced whole, never deduplicated
    against other statements. ``loaded`` names statements that arrive without positions as well."""
    ids = incoming.select("statement_id") if loaded is None else loaded.select("statement_id")
    return delete_keys(stored, ids, ["statement_id"]).unionByName(incoming)


def load_counts(incoming: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per loaded statement: trades received, stored and skipped."""
    got = incoming.groupBy("statement_id").agg(F.count("*").alias("received"))
    kept = accepted.groupBy("statement_id").agg(F.count("*").alias("stored"))
    return got.join(kept, "statement_id", "left").select(
        "statement_id", "received", F.coalesce("stored", F.lit(0)).alias("stored"),
        (F.col("received") - F.coalesce("stored", F.lit(0))).alias("skipped"),
    )


def cascade_delete(
    statements: DataFrame, positions: DataFrame, trades: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the statements in ``doomed`` (id)."""
    ids = doomed.select(F.col("id").alias("statement_id"))
    return (
        delete_keys(statements, doomed, ["id"]),
        delete_keys(positions, ids, ["statement_id"]),
        delete_keys(trades, ids, ["statement_id"]),
    )
