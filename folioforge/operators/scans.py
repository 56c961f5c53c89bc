"""Ordered computations that survive a hot key, and global ones that avoid a single-task window.

A plain window sends all rows of a key to one task. :func:`in_segments` cuts the ordered rows into segments of a
bounded size, whatever the keys, and :func:`segment_scan` scans them in three levels: segments, the segments of a range
of rows, and the ranges of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.keyed import null_safe_join
from folioforge.operators.lineage import written_once

SEGMENT_ROWS = 20_000
TIE_BYTES = 3


def in_segments(
    df: DataFrame, order: Sequence[str], rows: int = SEGMENT_ROWS, place: str | None = None, facts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The rows in segments of at most ``rows`` neighbours in ``order``, as columns ``part`` and ``seg``.

    Rows are dealt out by ranges of the order, sorted within their partition and counted there, so a segment is bounded
    whatever the keys look like: a hot key simply has many of them. ``part`` numbers the ranges, ``seg`` the segments of one range.
    ``place`` names a column for the number of each row, ascending in ``order`` and without gaps inside a range.
    The result is written once, because the numbers must not be drawn again; ``facts`` adds columns to the rows as they are written.
    """
    number = F.col("__place")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    segments = ordered.withColumns({
        "part": F.shiftright(number, 33).cast("int"), "seg": F.floor(F.pmod(number, F.lit(1 << 33)) / rows).cast("int"),
        **({place: number} if place else {}),
    }).drop("__place")
    return written_once(facts(segments) if facts else segments)


def segment_scan(
    df: DataFrame, keys: Sequence[str], order: str, last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Running state per key over rows placed by :func:`in_segments` (or summaries that kept their ``part`` and ``seg``).

    ``last`` names expressions whose last non-null value up to the row is wanted, ``sums`` running sums, the row
    included. A segment's state is summarised, the summaries are combined over the segments of a range, those of the
    ranges over the key ("last set wins", sums add up), and rows are finished inside their segment. No window holds more
    than a segment's rows, a range's segments or the ranges of a key. Keys must not be null.
    """
    last, sums = last or {}, sums or {}
    c = F.col
    whole, ranges = [*keys, "part", "seg"], [*keys, "part"]
    staged = df.withColumns({f"__set_{n}": e for n, e in last.items()} | {f"__add_{n}": e for n, e in sums.items()})

    def newest(prefix: str, by: str) -> list[Column]:
        return [F.max_by(f"{prefix}{n}", F.when(c(f"{prefix}{n}").isNotNull(), c(by))).alias(f"__last_{n}") for n in last]

    def earlier(partition: Sequence[str], by: str, tag: str) -> dict[str, Column]:
        before = Window.partitionBy(*partition).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return {f"__{tag}_{n}": F.last(f"__last_{n}", ignorenulls=True).over(before) for n in last} | {
            f"__{tag}_{n}": F.sum(f"__sum_{n}").over(before) for n in sums}

    # Written, since it is read twice: the rows are summarised once.
    by_segment = written_once(staged.groupBy(*whole).agg(*newest("__set_", order), *[F.sum(f"__add_{n}").alias(f"__sum_{n}") for n in sums]))
    by_range = by_segment.groupBy(*ranges).agg(*newest("__last_", "seg"), *[F.sum(f"__sum_{n}").alias(f"__sum_{n}") for n in sums])
    outer = by_range.withColumns(earlier(keys, "part", "outer")).select(*ranges, *[f"__outer_{n}" for n in [*last, *sums]])
    carried = by_segment.withColumns(earlier(ranges, "seg", "inner")).join(outer, ranges).select(
        *whole, *[F.coalesce(f"__inner_{n}", f"__outer_{n}").alias(f"__before_{n}") for n in last],
        *[(F.coalesce(f"__inner_{n}", F.lit(0)) + F.coalesce(f"__outer_{n}", F.lit(0))).alias(f"__before_{n}") for n in sums])
    inside = Window.partitionBy(*whole).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.join(carried, whole)
        .withColumns({n: F.coalesce(F.last(f"__set_{n}", ignorenulls=True).over(inside), c(f"__before_{n}")) for n in last} | {
            n: F.sum(f"__add_{n}").over(inside) + c(f"__before_{n}") for n in sums})
        .drop(*[f"__set_{n}" for n in last], *[f"__add_{n}" for n in sums], *[f"__before_{n}" for n in [*last, *sums]])
    )


def exponential_average(
    df: DataFrame, key: str, order: str, value: str, span: int, alias: str, position: str
) -> DataFrame:
    """Recursive exponential average (weight 2/(span+1), seeded with the first value) for every row.

    ``position`` is the 1-based row number inside the key. The recursion unrolls into a weighted
    sum; to keep the weights in range the rows are cut into blocks over which the decay is 1e-18. A block is summarised
    by its own weighted sum, and the sums of the blocks before are composed by the same recursion, block by block, as
    far back as their weight is a number at all (eighteen blocks; before that it is zero in double precision).
    All windows are partitioned by the key, so no exchange is added to the one for the position.
    """
    alpha = 2.0 / (span + 1.0)
    decay = 1.0 - alpha
    width = max(1, math.ceil(18.0 * math.log(10.0) / -math.log(decay)))
    block_decay = decay ** width
    reach = math.ceil(math.log(5e-324) / math.log(block_decay))
    block = F.floor((F.col(position) - 1) / F.lit(width)).cast("int")
    offset = ((F.col(position) - 1) % F.lit(width)).cast("double")
    seed = F.col(position) == 1
    inside = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    previous = Window.partitionBy(key).orderBy("__block").rangeBetween(-reach, -1)
    local = F.sum(
        F.when(seed, F.col(value)).otherwise(F.col(value) * alpha) * F.pow(F.lit(decay), -F.col("__offset"))
    ).over(inside) * F.pow(F.lit(decay), F.col("__offset"))
    tails = F.collect_list(F.when(F.col("__offset") == width - 1, F.struct("__block", "__local"))).over(previous)
    carried = F.aggregate(F.array_sort("__tails"), F.lit(0.0), lambda before, t: before * block_decay + t["__local"])
    return (
        df.withColumn("__block", block).withColumn("__offset", offset)
        .withColumn("__local", local)
        .withColumn("__tails", tails)
        .withColumn(alias, F.col("__local") + carried * F.pow(F.lit(decay), F.col("__offset") + 1))
        .drop("__block", "__offset", "__local", "__tails")
    )


def rank_by_score(
    df: DataFrame, score: str, tie: str, alias: str = "rank", groups: Sequence[str] = (), decimals: int = 1
) -> DataFrame:
    """1..N by descending score, ties by ``tie``, without sorting everything in one task.

    Scores lie on a grid of 10^-decimals, so a histogram of the distinct scores gives the number of
    better rows; only rows with an equal score are ranked among themselves. Rows without a score come last, by the text of
    ``tie``, and only those with the same first bytes are ranked among themselves. ``groups`` must not be null.
    """
    # Rows without a score fall into cells below all others, by the first bytes of their tie column, which keep its order.
    start = F.rpad(F.hex(F.substring(F.encode(F.col(tie).cast("string"), "UTF-8"), 1, TIE_BYTES)), 2 * TIE_BYTES, "0")
    unscored = F.lit(-(1 << 62)) - F.coalesce(F.conv(start, 16, 10).cast("long"), F.lit(-1))
    cell = F.coalesce(F.round(F.col(score) * (10 ** decimals)).cast("long"), unscored)
    staged = df.withColumn("__cell", cell)
    ahead = Window.partitionBy(*groups).orderBy(F.col("__cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*groups, "__cell").agg(F.count("*").alias("__n"))
        .withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
        .drop("__n")
    )
    peers = Window.partitionBy(*groups, "__cell").orderBy(F.col(score).desc_nulls_last(), tie)
    return (
        staged.join(offsets, [*groups, "__cell"])
        .withColumn(alias, (F.col("__ahead") + F.row_number().over(peers)).cast("long"))
        .drop("__cell", "__ahead")
    )


def share_of_total(
    df: DataFrame, value: str, alias: str, scope: Sequence[str] = (), factor: float = 100.0
) -> DataFrame:
    """Value as a share of its scope total; the total is an aggregation, not a window over the scope."""
    share = F.try_divide(F.col(value).cast("double"), F.col("__total").cast("double")) * factor
    if scope:
        totals = df.groupBy(*scope).agg(F.sum(value).alias("__total"))
        return null_safe_join(df, totals, scope).withColumn(alias, share).drop("__total")
    total = df.agg(F.sum(value).alias("__total")).scalar()
    return df.withColumn("__total", total).withColumn(alias, share).drop("__total")
