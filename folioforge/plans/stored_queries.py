"""Stored tables: every query writes to a fresh folder in the session's shared place and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import quality as Q
from folioforge.operators.lineage import fresh_path
from folioforge.plans import landed_views as L
from folioforge.plans import views as V
from folioforge.plans.registry import query, show
from folioforge.sources import landed, tables


@query("stored_upsert_prices", ("daily_prices",), """
SELECT symbol, price_date, close + CASE WHEN price_date >= DATE '2000-01-01' AND symbol = 'MKT' THEN 1 ELSE 0 END AS close
FROM daily_prices""", days=("price_date",))
def stored_upsert_prices(spark, sf):
    """All bars stored, then the benchmark's bars since 2000 corrected by one."""
    root, bars = fresh_path(spark, "tables"), V.daily_prices(spark, sf)
    tables.write_table(bars, root, "daily_prices")
    late = bars.where((F.col("symbol") == "MKT") & (F.col("price_date") >= F.lit("2000-01-01").cast("date"))).withColumn("close", F.col("close") + 1)
    tables.upsert_table(late, root, "daily_prices", [F.col("close").desc()])
    return show(tables.read_table(spark, root, "daily_prices").select("symbol", "price_date", "close"))


@query("stored_delete_metrics", ("stock_metrics",), """
SELECT symbol, metric_name, count(*) AS rows FROM stock_metrics
WHERE NOT (metric_name = 'revenue' AND fiscal_year = 1998) GROUP BY ALL""")
def stored_delete_metrics(spark, sf):
    """All metrics stored, then one metric of one fiscal year deleted."""
    root, metrics = fresh_path(spark, "tables"), V.stock_metrics(spark, sf)
    tables.write_table(metrics, root, "stock_metrics")
    doomed = metrics.where("metric_name = 'revenue' AND fiscal_year = 1998").select("symbol", "metric_name", "period_end", "fiscal_period")
    tables.delete_from_table(spark, root, "stock_metrics", doomed, ["symbol", "metric_name", "period_end", "fiscal_period"])
    return show(tables.read_table(spark, root, "stock_metrics").groupBy("symbol", "metric_name").agg(F.count("*").alias("rows")))


@query("stored_statement_load", ("statements", "positions_overlap", "trades_overlap"), """
SELECT 'positions' AS child, statement_id, count(*) AS rows, sum(quantity)::DOUBLE AS quantity FROM positions_overlap GROUP BY ALL
UNION ALL SELECT 'trades', statement_id, count(*), sum(quantity)::DOUBLE FROM trades_overlap WHERE statement_id NOT LIKE '%overlap' GROUP BY ALL
UNION ALL SELECT 'statements', id, 1, 0 FROM statements""")
def stored_statement_load(spark, sf):
    """Yearly statements are stored, then the overlapping ones (whose trades all exist) and the first year once more."""
    root = fresh_path(spark, "tables")
    base = V.stored(V.trades_base, spark, sf)
    heads, positions, trades = V.stored(V.statements, spark, sf), V.stored(V.positions_overlap, spark, sf, base), V.trades_overlap(spark, sf, base)
    overlap = F.col("id").endswith("-overlap")
    first = F.col("period_end") == heads.agg(F.min("period_end")).scalar()
    for load in (heads.where(~overlap), heads.where(overlap | first)):
        ids = load.select(F.col("id").alias("statement_id"))
        tables.store_statements(root, load, positions.join(ids, "statement_id", "left_semi"), trades.join(ids, "statement_id", "left_semi"))
    counts = [
        tables.read_table(spark, root, child).groupBy("statement_id").agg(F.count("*").alias("rows"), F.sum("quantity").alias("quantity"))
        .select(F.lit(child).alias("child"), "statement_id", "rows", "quantity") for child in ("positions", "trades")
    ]
    stored = tables.read_table(spark, root, "statements").select(
        F.lit("statements").alias("child"), F.col("id").alias("statement_id"), F.lit(1).cast("bigint").alias("rows"), F.lit(0).cast("decimal(38,10)").alias("quantity"))
    return show(counts[0].unionByName(counts[1]).unionByName(stored))


@query("stored_cascade_delete", ("statements", "positions", "trades"), """
SELECT 'positions' AS child, statement_id, count(*) AS rows FROM positions
WHERE statement_id LIKE '%7' OR split_part(statement_id, '-', 1) <> 'U3' AND statement_id NOT LIKE '%1996' GROUP BY ALL
UNION ALL SELECT 'trades', statement_id, count(*) FROM trades
WHERE statement_id LIKE '%7' OR split_part(statement_id, '-', 1) <> 'U3' AND statement_id NOT LIKE '%1996' GROUP BY ALL
UNION ALL SELECT 'statements', id, 1 FROM statements
WHERE id LIKE '%7' OR split_part(id, '-', 1) <> 'U3' AND id NOT LIKE '%1996'""")
def stored_cascade_delete(spark, sf):
    """Statements, positions and trades stored; then one year, and one account but for a year, deleted with all children."""
    root = fresh_path(spark, "tables")
    base = V.stored(V.trades_base, spark, sf)
    for table, rows in (("statements", V.statements(spark, sf)), ("positions", V.positions(spark, sf, base)), ("trades", V.trades(spark, sf, base))):
        tables.write_table(rows, root, table)
    heads = tables.read_table(spark, root, "statements")
    gone = ((F.col("account_id") == "U3") | F.col("id").endswith("1996")) & ~F.col("id").endswith("7")
    tables.delete_statements(spark, root, heads.where(gone).select("id"))
    kept = [
        tables.read_table(spark, root, child).groupBy("statement_id").agg(F.count("*").alias("rows"))
        .select(F.lit(child).alias("child"), "statement_id", "rows") for child in ("positions", "trades")
    ]
    left = tables.read_table(spark, root, "statements").select(
        F.lit("statements").alias("child"), F.col("id").alias("statement_id"), F.lit(1).cast("bigint").alias("rows"))
    return show(kept[0].unionByName(kept[1]).unionByName(left))


@query("checked_metric_load", ("stock_metrics",), """
SELECT unnest(['received', 'accepted', 'rule symbol', 'rule metric_value', 'rule period_end', 'rule cik', 'inserted', 'updated', 'stored', 'quarantined']) AS figure,
 unnest([received, accepted, blanks, valueless, 0, companyless, inserted, updated, stored, quarantined]) AS rows FROM (
 SELECT count(*) AS received, count(*) FILTER (sound) AS accepted, count(*) FILTER (blank) AS blanks, count(*) FILTER (valueless) AS valueless,
  count(*) FILTER (companyless) AS companyless, count(*) FILTER (sound AND NOT early) AS inserted, count(*) FILTER (sound AND early) AS updated,
  count(*) FILTER (sound OR early) AS stored, count(*) FILTER (NOT sound) AS quarantined
 FROM (SELECT *, NOT (blank OR valueless OR companyless) AS sound FROM (
  SELECT year(period_end) < 1997 AS early, fiscal_year % 5 = 0 AND metric_name = 'revenue' AS blank,
   fiscal_year % 7 = 0 AND metric_name = 'net_income' AS valueless, fiscal_year % 3 = 0 AND metric_name = 'total_assets' AS companyless
  FROM stock_metrics) flags) judged) counted""")
def checked_metric_load(spark, sf):
    """Metrics before 1997 stored; then all come again with spaces and capitals, some without symbol, value or CIK."""
    root, metrics = fresh_path(spark, "tables"), V.stock_metrics(spark, sf).withColumn("source", F.lit("SEC_EDGAR"))
    tables.write_table(Q.clean_metrics(metrics.where(F.year("period_end") < 1997)), root, "stock_metrics")

    def spoiled(column: str, metric: str, every: int, value):
        return F.when((F.col("fiscal_year") % every == 0) & (F.lower(F.trim("metric_name")) == metric), value).otherwise(F.col(column))

    second = metrics.withColumn("metric_name", F.concat(F.lit(" "), F.upper("metric_name"))).withColumns({
        "symbol": spoiled("symbol", "revenue", 5, F.lit("  ")), "metric_value": spoiled("metric_value", "net_income", 7, F.lit(None)),
        "cik": spoiled("cik", "total_assets", 3, F.lit(None))})
    report = tables.upsert_checked(Q.clean_metrics(second), root, "stock_metrics", Q.metric_rules(), [F.col("metric_value")])
    observed = {"received": report.received, "accepted": report.accepted, **{f"rule {k}": v for k, v in report.broken.items()},
                "inserted": report.inserted, "updated": report.updated}
    rows = spark.createDataFrame(list(observed.items()), "figure string, rows long")
    stored = tables.read_table(spark, root, "stock_metrics").agg(F.lit("stored").alias("figure"), F.count("*").alias("rows"))
    held = report.quarantine.agg(F.lit("quarantined").alias("figure"), F.count("*").alias("rows"))
    return rows.unionByName(stored).unionByName(held)


@query("landed_rows_quarantine", ("trades",), """
SELECT statement_id AS file_id, CASE WHEN quantity = 9 THEN 'malformed' WHEN quantity = 11 THEN 'place' ELSE 'kept' END AS reason, count(*) AS rows
FROM trades GROUP BY ALL""")
def landed_rows_quarantine(spark, sf):
    """One JSON line a trade, written to the shared folder; some are cut off in the middle, some have no row number."""
    path = fresh_path(spark, "lines")
    number = F.when(F.col("quantity") == 11, F.lit(None)).otherwise(F.lit(1)).cast("bigint")
    line = F.to_json(F.struct(
        F.col("statement_id").alias("file_id"), F.lit(1).cast("bigint").alias("page"), F.lit(1).cast("bigint").alias("table_no"),
        number.alias("row_no"), F.array("symbol", "side").alias("cells")))
    cut = F.when(F.col("quantity") == 9, F.substr("line", F.lit(1), F.length("line") - 5)).otherwise(F.col("line"))
    V.trades(spark, sf).withColumn("line", line).select(cut.alias("value")).write.text(path)
    kept, lost = landed.landed_statement_rows(spark, path)
    named = lost.select(F.regexp_extract("raw", '"file_id":"([^"]*)"', 1).alias("file_id"), "reason")
    return kept.select("file_id", F.lit("kept").alias("reason")).unionByName(named).groupBy("file_id", "reason").agg(F.count("*").alias("rows"))


@query("landed_facts_quarantine", ("stock_metrics",), """
SELECT lpad(CAST(n AS VARCHAR), 10, '0') AS cik, CASE WHEN n % 5 = 0 THEN 'malformed' WHEN n % 7 = 0 THEN 'facts' ELSE 'kept' END AS reason, count(*) AS files
FROM (SELECT DISTINCT CAST(cik AS INT) AS n FROM stock_metrics) c GROUP BY ALL""")
def landed_facts_quarantine(spark, sf):
    """One facts file a company; some end in the middle, some have no fact tree."""
    path, number = fresh_path(spark, "facts"), F.col("cik").cast("int")
    body = (
        F.when(number % 5 == 0, F.substr("body", F.lit(1), F.length("body") - 3))
        .when(number % 7 == 0, F.regexp_replace("body", '"facts":', '"other":')).otherwise(F.col("body"))
    )
    L.company_documents(spark, sf).select("cik", body.alias("value")).write.partitionBy("cik").text(path)
    kept, lost = landed.landed_company_facts(spark, path + "/*/")
    found = F.lpad(F.regexp_extract("body", r'"cik":(\d+)', 1), 10, "0").alias("cik")
    rows = kept.select(found, F.lit("kept").alias("reason")).unionByName(lost.select(found, "reason"))
    return rows.groupBy("cik", "reason").agg(F.count("*").alias("files"))
