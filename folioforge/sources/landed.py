"""Landed files: company facts, ticker map, daily bars and statement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators.prices import normalize_prices

STATEMENT_ROWS = "file_id string, page bigint, table_no bigint, row_no bigint, cells array<string>"


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document (cik, body); the CIK is the digit run of the file name, else of the body.

    Files that Spark wrote itself (``part-...``) have no CIK in their names.
    """
    body = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    base = F.element_at(F.split("file", "/"), -1)
    name = F.when(~base.startswith("part-"), F.regexp_extract(base, r"(\d{1,10})", 1))
    inside = F.get_json_object("value", "$.cik")
    return body.select(
        F.lpad(F.coalesce(F.nullif(name, F.lit("")), inside), 10, "0").alias("cik"), F.col("value").alias("body")
    )


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """Ticker rows of a JSON object whose values are {ticker, cik_str} records."""
    entries = F.from_json("value", "map<string, struct<ticker: string, cik_str: bigint>>")
    return spark.read.text(path, wholetext=True).select(F.explode(F.map_values(entries)).alias("e")).select("e.*")


def read_bars(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Landed bars in table form. Everything is read as text so that bad values can be quarantined."""
    names = ["symbol", "price_date", "open", "high", "low", "close", "adj_close", "volume"]
    if fmt == "csv":
        raw = spark.read.option("header", True).schema(", ".join(f"{n} string" for n in names)).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    return normalize_prices(raw)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Well-formed records of JSON lines, and the lines that are not (file, raw).

    A line is malformed if it is no JSON object or if a value does not fit its column; such a line goes whole to the
    second relation, so that no field of it is silently null. Absent fields are null; blank lines are ignored.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    wanted = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.withColumn("record", F.from_json("raw", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("record").isNull() | F.col("record._corrupt").isNotNull()
    return (
        parsed.where(~bad).select("file", *[F.col(f"record.{name}").alias(name) for name in fields.names]),
        parsed.where(bad).select("file", "raw"),
    )


def landed_statement_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Statement rows of JSON lines that can be placed in a table, and the lines that cannot, with the reason.

    Reasons: ``malformed`` lines, and rows without a ``place`` (file, page, table, row or cells). Null cells become empty.
    """
    rows, broken = read_json_lines(spark, path, STATEMENT_ROWS)
    place = ["file_id", "page", "table_no", "row_no", "cells"]
    placed = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in place))
    kept = rows.where(placed).withColumn("cells", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))))
    lost = rows.where(~placed).select("file", F.to_json(F.struct(*place)).alias("raw"), F.lit("place").alias("reason"))
    return kept.drop("file"), broken.withColumn("reason", F.lit("malformed")).unionByName(lost)


def landed_company_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Facts documents (cik, body) that hold facts of one company, and the files that do not, with the reason.

    Reasons: ``malformed`` if the body is no JSON object, ``cik`` if neither name nor body gives one, ``facts`` if
    there is no fact tree. A file of no bytes holds no document and is in neither relation.
    """
    documents = read_company_facts(spark, path)
    shape = F.from_json("body", "cik string, facts map<string, string>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    reason = (
        F.when(F.col("shape").isNull() | F.col("shape._corrupt").isNotNull(), "malformed")
        .when(~F.coalesce(F.col("cik").rlike("[1-9]"), F.lit(False)), "cik")
        .when(F.col("shape.facts").isNull(), "facts")
    )
    judged = documents.withColumn("shape", shape).withColumn("reason", reason).drop("shape")
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def read_statement_rows(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Extracted table rows (file_id, page, table_no, row_no, cells); null cells become empty text."""
    rows = spark.read.schema(STATEMENT_ROWS).format(fmt).load(path)
    return rows.withColumn("cells", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))))
