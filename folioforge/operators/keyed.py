"""Keyed relations: first/latest row per key, upsert, delete and null-safe joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; key columns appear once in the result."""
    renamed = right.select(*[
        F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns
    ])
    cond = None
    for k in keys:
        clause = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = clause if cond is None else cond & clause
    joined = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "full_outer", "outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys})
    elif how in ("right", "right_outer"):
        joined = joined.withColumns({k: F.col(f"__r_{k}") for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])


def dealt_out(side: DataFrame) -> DataFrame:
    """A side of a join that is dealt out with the other one by their keys, whatever its size.

    For relations that grow with the input: compressed files look small enough to be broadcast long after the rows in them, several
    relations at a time, are much of what a driver holds.
    """
    return side.hint("merge")


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank filter is pushed below the shuffle as a per-task group limit, so many copies of one
    key are cut to one per task before they travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with their position in ``position``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def latest_value(df: DataFrame, keys: Sequence[str], columns: Sequence[str], by: str) -> DataFrame:
    """Columns of the row with the greatest ``by`` per key, as one hash-partial aggregation."""
    return df.groupBy(*keys).agg(
        F.max(by).alias(by), *[F.max_by(c, by).alias(c) for c in columns if c != by]
    )


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], last: Sequence[Column]) -> DataFrame:
    """Target after writing ``source``: matching keys replaced, others appended.

    ``last`` orders duplicate source rows so that the winning (last written) one comes first.
    Columns missing on one side become null, as after an additive schema change.
    """
    incoming = first_per_key(source, keys, last)
    kept = null_safe_join(target, incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def upsert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct source keys are new and how many already exist."""
    incoming = source.select(*keys).distinct()
    known = target.select(*keys).distinct().withColumn("known", F.lit(True))
    return null_safe_join(incoming, known, keys, "left").agg(
        F.count_if(F.col("known").isNull()).alias("inserted"),
        F.count_if(F.col("known")).alias("updated"),
    )


def delete_keys(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target without the rows whose key appears in ``doomed``."""
    return null_safe_join(target, doomed.select(*keys).distinct(), keys, "left_anti")
