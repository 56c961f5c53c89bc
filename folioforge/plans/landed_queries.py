"""Queries over landed inputs: statement rows, company facts, raw bars, and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import facts as A
from folioforge.operators import prices as P
from folioforge.operators import quality as Q
from folioforge.operators import statement_rows as S
from folioforge.operators.lineage import distilled_in_slices
from folioforge.plans import landed_views as L
from folioforge.plans import views as V
from folioforge.plans.registry import query, show


def _from_rows(spark, sf, read):
    """Land the rows, then classify and ``read`` them slice by slice; a slice's rows and segments go when its result is written.

    Classified rows are not written: they are the segments with what they look up in small tables.
    """
    landed = lambda: [S.packed_rows(rows) for rows in L.statement_rows(spark, sf)]
    return distilled_in_slices(spark, landed, "file_id", lambda rows: read(S.classify_rows(rows)))


@query("statement_headers", ("statements",), """
SELECT id AS file_id, account_id, 'SGD' AS base_currency, period_start, period_end FROM statements WHERE id NOT LIKE '%overlap'""",
       days=("period_start", "period_end"))
def statement_headers(spark, sf):
    return show(_from_rows(spark, sf, S.statement_headers).drop("account_seq"))


@query("parsed_positions", ("positions",), """
SELECT statement_id AS file_id, account_id, symbol, asset_class, quantity::DOUBLE AS quantity, cost_basis::DOUBLE AS cost_basis,
 market_price::DOUBLE AS market_price, market_value::DOUBLE AS market_value, unrealized_pnl::DOUBLE AS unrealized_pnl, currency,
 statement_date, expiry, strike::DOUBLE AS strike, "right" FROM (SELECT *, split_part(statement_id, '-', 1) AS account_id FROM positions) p""",
       days=("statement_date", "expiry"))
def parsed_positions(spark, sf):
    def read(classified):
        rows = Q.accept(S.extract_positions(classified, S.statement_headers(classified)), Q.position_rules())
        return rows.drop("account_seq", "cells")

    return show(_from_rows(spark, sf, read))


@query("parsed_trades", ("trades",), """
SELECT statement_id AS file_id, strftime(trade_date, '%Y-%m-%d %H:%M:%S') AS trade_time, symbol, asset_class, side, quantity::DOUBLE AS quantity,
 price::DOUBLE AS price, proceeds::DOUBLE AS proceeds, commission::DOUBLE AS commission, realized_pnl::DOUBLE AS realized_pnl, expiry,
 strike::DOUBLE AS strike, "right" FROM trades""", days=("expiry",))
def parsed_trades(spark, sf):
    def read(classified):
        rows = Q.accept(S.extract_trades(classified, S.statement_headers(classified)), Q.trade_rules())
        return rows.select(
            "file_id", F.date_format("trade_date", "yyyy-MM-dd HH:mm:ss").alias("trade_time"), "symbol", "asset_class", "side",
            "quantity", "price", "proceeds", "commission", "realized_pnl", "expiry", "strike", "right")

    return show(_from_rows(spark, sf, read))


@query("row_diagnosis_counts", ("positions", "statements"), """
SELECT id AS file_id, coalesce(n, 0) + 5 + 2 + 3 + 9 + CAST(9 AS BIGINT) + 1 AS rows, coalesce(n, 0) AS parsed, CAST(1 AS BIGINT) AS skipped,
 CAST(1 + 1 + 9 + 3 + 1 AS BIGINT) AS headers, CAST(5 AS BIGINT) AS outside
FROM statements LEFT JOIN (SELECT statement_id, count(*) AS n FROM positions GROUP BY 1) p ON p.statement_id = id WHERE id NOT LIKE '%overlap'""")
def row_diagnosis_counts(spark, sf):
    return show(_from_rows(spark, sf, lambda classified: S.diagnosis_counts(S.diagnose(classified))).drop("account_seq"))


@query("problem_context_rows", ("statements",), """
SELECT id AS file_id, CAST(15 AS BIGINT) AS rows, CAST(1 AS BIGINT) AS problems FROM statements WHERE id NOT LIKE '%overlap'""")
def problem_context_rows(spark, sf):
    context = _from_rows(spark, sf, lambda classified: S.problem_context(S.diagnose(classified)).select("file_id", "classification"))
    return show(context.groupBy("file_id").agg(F.count("*").alias("rows"), F.count_if(F.col("classification").isin(S.PROBLEM_CLASSES)).alias("problems")))


@query("statement_row_search", ("positions",), """
SELECT statement_id AS file_id, symbol AS detail FROM positions WHERE lower(symbol) LIKE '%brand#2%'""")
def statement_row_search(spark, sf):
    def read(classified):
        found = S.search_rows(S.diagnose(classified), " BRAND#2 ")
        return found.where(F.col("classification") == "parsed").select("file_id", "detail")

    return _from_rows(spark, sf, read)


def _facts(spark, sf):
    tickers = L.ticker_map(spark, sf)
    return A.facts_to_metrics(tickers.select(F.upper("ticker").alias("symbol")), tickers, L.company_documents(spark, sf))


@query("facts_to_metrics", ("stock_metrics",), """
SELECT upper(symbol) AS symbol, metric_name, metric_value::DOUBLE AS metric_value, period_end, period_start, fiscal_period,
 fiscal_year::BIGINT AS fiscal_year, duration_days::BIGINT AS duration_days, cik, filing_type FROM stock_metrics""",
       days=("period_end", "period_start"))
def facts_to_metrics(spark, sf):
    rows = Q.accept(_facts(spark, sf), Q.metric_rules())
    return show(rows.drop("reporting_style", "source"))


@query("company_styles", ("stock_metrics",), """
SELECT cik, CASE WHEN n = 25 THEN 'annual_only' WHEN n % 2 = 1 THEN 'mixed' ELSE 'standalone_quarterly' END AS reporting_style
FROM (SELECT DISTINCT cik, CAST(cik AS INT) AS n FROM stock_metrics) c""")
def company_styles(spark, sf):
    return A.company_styles(L.company_documents(spark, sf))


@query("resolved_ciks", ("stock_metrics",), """
SELECT DISTINCT upper(symbol) AS symbol, cik FROM stock_metrics UNION ALL SELECT 'GOOG', NULL""")
def resolved_ciks(spark, sf):
    tickers = L.ticker_map(spark, sf)
    symbols = tickers.select(F.concat(F.lit(" "), "ticker").alias("symbol")).unionByName(spark.createDataFrame([("goog",)], "symbol string"))
    return A.resolve_ciks(symbols, tickers)


@query("normalized_bars", ("daily_prices",), """
SELECT upper(symbol) AS symbol, price_date, open::DOUBLE AS open, close::DOUBLE AS close, adj_close::DOUBLE AS adj_close, volume
FROM daily_prices WHERE NOT (volume % 97 = 0)""", days=("price_date",))
def normalized_bars(spark, sf):
    raw = V.daily_prices(spark, sf).select(
        F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"), F.col("price_date").cast("string").alias("price_date"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low")],
        F.when(F.col("volume") % 97 == 0, "n/a").otherwise(F.col("close").cast("string")).alias("close"),
        F.col("volume").cast("string").alias("volume"))
    good = Q.accept(P.normalize_prices(raw), Q.price_rules())
    return show(good.select("symbol", "price_date", "open", "close", "adj_close", "volume"))


@query("quarantined_bars", ("daily_prices",), """
SELECT upper(symbol) AS symbol, price_date, 'close' AS violations FROM daily_prices WHERE volume % 97 = 0""", days=("price_date",))
def quarantined_bars(spark, sf):
    raw = V.daily_prices(spark, sf).withColumn("close", F.when(F.col("volume") % 97 == 0, "n/a").otherwise(F.col("close").cast("string")))
    bad = Q.quarantine(P.normalize_prices(raw), Q.price_rules())
    return show(bad.select("symbol", "price_date", F.array_join("violations", ",").alias("violations")))


@query("quarantined_trades", ("trades",), """
SELECT CASE WHEN asset_class = 'OPT' AND ("right" = 'P' AND quantity = 7) THEN 'option_terms,right' ELSE 'side' END AS violations, count(*) AS rows
FROM trades WHERE quantity = 9 OR (asset_class = 'OPT' AND "right" = 'P' AND quantity = 7) GROUP BY 1""")
def quarantined_trades(spark, sf):
    broken = (F.col("right") == "P") & (F.col("quantity") == 7)
    rows = V.trades(spark, sf).withColumns({
        "side": F.when(F.col("quantity") == 9, "XXX").otherwise(F.col("side")),
        "expiry": F.when(broken, None).otherwise(F.col("expiry")), "right": F.when(broken, "X").otherwise(F.col("right")),
    })
    bad = Q.quarantine(rows, Q.trade_rules())
    return bad.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("rows"))
