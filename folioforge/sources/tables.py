"""The six tables: typed reads and partition-wise keyed writes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators.keyed import delete_keys, first_per_key, null_safe_join
from folioforge.operators.lineage import written_once
from folioforge.operators.quality import with_violations
from folioforge.operators.statements import accepted_trades
from folioforge.schemas import KEYS, TABLES
from folioforge.sources import loads
from folioforge.sources.loads import PARTITION_COLUMN

# Tables are partitioned by the year of their date: coarse enough for large files, fine enough that
# a load rewrites only the years it touches.
_PARTITION_DATE = {
    "statements": "period_end", "positions": "statement_date", "trades": "trade_date",
    "stock_metrics": "period_end", "daily_prices": "price_date", "valuation_snapshots": "snapshot_date",
}


def _partition_value(table: str) -> Column:
    return F.coalesce(F.year(_PARTITION_DATE[table]), F.lit(0))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table schema in order and type; absent optional ones become null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TABLES[table].fields
    ])


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Typed scan. Filters on the date column are not needed to prune; filter on ``part_year`` for that.

    Partitions of a committed load that the table does not hold yet are read from the load's staged files.
    """
    schema = T.StructType([*TABLES[table].fields, T.StructField(PARTITION_COLUMN, T.IntegerType())])
    path, waiting = f"{root}/{table}", loads.pending(spark, root, table)
    if waiting is None:
        return spark.read.schema(schema).parquet(path)
    staged, years = waiting
    fresh = spark.read.schema(schema).parquet(staged)
    if not loads.exists(spark, path):
        return fresh
    return spark.read.schema(schema).parquet(path).where(~F.col(PARTITION_COLUMN).isin(years)).unionByName(fresh)


def write_table(df: DataFrame, root: str, table: str, mode: str = "overwrite") -> None:
    """Write conformed rows partitioned by year; overwrite replaces the whole table. A stopped load is ended first."""
    loads.recover(df.sparkSession, root)
    (
        conform(df, table).withColumn(PARTITION_COLUMN, _partition_value(table))
        .write.mode(mode).option("partitionOverwriteMode", "static").option("compression", loads.CODEC).partitionBy(PARTITION_COLUMN)
        .parquet(f"{root}/{table}")
    )


def _years(df: DataFrame) -> set[int]:
    """The partitions of some rows; there are as many as calendar years."""
    return {int(r[0]) for r in df.select(PARTITION_COLUMN).distinct().collect()}


def _replacement(
    stored: DataFrame | None, doomed: DataFrame, keys: Sequence[str], incoming: DataFrame | None, years: set[int],
) -> DataFrame | None:
    """New content of the partitions ``years``: their rows without the doomed keys, and the incoming rows."""
    parts = [incoming] if incoming is not None else []
    if stored is not None and years:
        parts.append(delete_keys(stored.where(F.col(PARTITION_COLUMN).isin(sorted(years))), doomed, keys))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _write(spark: SparkSession, root: str, load: str, changes: dict[str, tuple[DataFrame | None, set[int]]]) -> None:
    """Stage the changed partitions of every table, then commit them together."""
    for table, (rows, years) in changes.items():
        if rows is not None and years:
            loads.stage(load, table, rows)
    loads.commit(spark, root, load, {table: years for table, (rows, years) in changes.items() if rows is not None})


def _stored(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The table after earlier loads have ended, or None before its first load."""
    return read_table(spark, root, table) if loads.exists(spark, f"{root}/{table}") else None


def _staged(df: DataFrame, table: str) -> DataFrame:
    return written_once(conform(df, table).withColumn(PARTITION_COLUMN, _partition_value(table)))


def _upsert(
    stored: DataFrame | None, df: DataFrame, table: str, last: Sequence[Column], keys: Sequence[str],
) -> tuple[DataFrame | None, set[int]]:
    # ``last`` may use columns that the table does not have, such as a load number.
    incoming = _staged(first_per_key(df, keys, last), table)
    years = _years(incoming)
    return _replacement(stored, incoming, keys, incoming, years), years


def upsert_table(df: DataFrame, root: str, table: str, last: Sequence[Column], keys: Sequence[str] | None = None) -> None:
    """Keyed upsert that reads and rewrites only the partitions the load touches.

    The key must contain the partition's date, so that a stored row and its replacement share a partition.
    """
    keys = list(keys or KEYS[table])
    if _PARTITION_DATE[table] not in keys:
        raise ValueError(f"the key of {table} has to contain {_PARTITION_DATE[table]}")
    spark = df.sparkSession
    load = loads.begin(spark, root)
    _write(spark, root, load, {table: _upsert(_stored(spark, root, table), df, table, last, keys)})


def _deletion(stored: DataFrame | None, doomed: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, set[int]]:
    if stored is None:
        return None, set()
    years = _years(stored.join(doomed.select(*keys).distinct(), list(keys), "left_semi"))
    return (_replacement(stored, doomed, keys, None, years) if years else None), years


def delete_from_table(spark: SparkSession, root: str, table: str, doomed: DataFrame, keys: Sequence[str]) -> None:
    """Delete by key, rewriting only the partitions that hold a doomed row."""
    load = loads.begin(spark, root)
    _write(spark, root, load, {table: _deletion(_stored(spark, root, table), doomed, keys)})


def delete_statements(spark: SparkSession, root: str, doomed: DataFrame) -> None:
    """Delete the statements in ``doomed`` (id) with their positions and trades, in one load.

    Ids that are not stored are ignored. Of each table only the partitions with a row of these statements are rewritten.
    """
    load = loads.begin(spark, root)
    # Written first, since ``doomed`` may be read from the tables that the load changes.
    ids = written_once(doomed.select("id").where(F.col("id").isNotNull()).distinct())
    children = ids.select(F.col("id").alias("statement_id"))
    _write(spark, root, load, {
        "statements": _deletion(_stored(spark, root, "statements"), ids, ["id"]),
        "positions": _deletion(_stored(spark, root, "positions"), children, ["statement_id"]),
        "trades": _deletion(_stored(spark, root, "trades"), children, ["statement_id"]),
    })


def store_statements(root: str, statements: DataFrame, positions: DataFrame, trades: DataFrame) -> None:
    """Store statements with their positions and trades in one load: readers see all of it or nothing.

    A header replaces the one with its key. The positions and trades of the same statement ids are replaced whole;
    trades that another stored statement of the account already has are left out. Such a trade has the same time,
    so only the years of the incoming trades are searched.
    """
    spark = statements.sparkSession
    load = loads.begin(spark, root)
    headers = written_once(statements)
    ids = headers.select(F.col("id").alias("statement_id")).distinct()
    old = {table: _stored(spark, root, table) for table in ("statements", "positions", "trades")}
    changes = {"statements": _upsert(
        old["statements"], headers, "statements", [F.col("created_at").desc(), F.col("id")], KEYS["statements"])}
    new = {"positions": _staged(positions, "positions"), "trades": _staged(trades, "trades")}
    for table, rows in new.items():
        stored, years = old[table], _years(rows)
        if stored is not None:
            if table == "trades":
                near = stored.where(F.col(PARTITION_COLUMN).isin(sorted(years)))
                near = near.join(headers.select("account_id").distinct(), "account_id", "left_semi")
                rows = accepted_trades(rows, delete_keys(near, ids, ["statement_id"]))
            years |= _years(stored.join(ids, "statement_id", "left_semi"))
        changes[table] = _replacement(stored, ids, ["statement_id"], rows, years), years
    _write(spark, root, load, changes)


@dataclass(frozen=True)
class LoadReport:
    """What a checked load did. ``broken`` counts the rows that break each rule (a row may break several)."""

    received: int
    accepted: int
    broken: dict[str, int]
    inserted: int
    updated: int
    quarantine: DataFrame


def upsert_checked(
    df: DataFrame, root: str, table: str, rules: dict[str, Column], last: Sequence[Column], keys: Sequence[str] | None = None,
) -> LoadReport:
    """Upsert the rows that keep all rules; the others are written to a quarantine relation with their violations.

    All counts are observed while the rows are written: the rule counts when they are parted, inserted and updated
    keys when the accepted rows are matched with the stored keys of their partitions. Nothing is read again to be counted.
    """
    spark, keys = df.sparkSession, list(keys or KEYS[table])
    load = loads.begin(spark, root)
    seen = Observation()
    judged = with_violations(df, rules).observe(
        seen, F.count(F.lit(1)).alias("received"), F.count_if(F.size("violations") == 0).alias("accepted"),
        *[F.count_if(F.array_contains("violations", name)).alias(f"rule_{name}") for name in rules])
    parted = written_once(judged)
    good = parted.where(F.size("violations") == 0).drop("violations")
    incoming = conform(first_per_key(good, keys, last), table).withColumn(PARTITION_COLUMN, _partition_value(table))
    stored, matched = _stored(spark, root, table), Observation()
    if stored is None:
        incoming = incoming.withColumn("known", F.lit(False))
    else:
        # Only the stored partitions of the load are searched for its keys.
        near = stored.where(F.col(PARTITION_COLUMN).isin(sorted(_years(incoming))))
        incoming = null_safe_join(incoming, near.select(*keys).distinct().withColumn("known", F.lit(True)), keys, "left")
    incoming = written_once(incoming.observe(
        matched, F.count_if(~F.coalesce("known", F.lit(False))).alias("inserted"), F.count_if("known").alias("updated"))).drop("known")
    years = _years(incoming)
    _write(spark, root, load, {table: (_replacement(stored, incoming, keys, incoming, years), years)})
    counts, met = seen.get, matched.get
    return LoadReport(
        counts["received"], counts["accepted"], {name: counts[f"rule_{name}"] for name in rules}, met["inserted"], met["updated"],
        parted.where(F.size("violations") > 0))


def export_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Selected columns as CSV files with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
