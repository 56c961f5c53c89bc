"""Landed inputs derived from the test tables: statement rows and company-facts documents.

They are written out by Spark from the positions, trades and fundamentals views, so their size
follows the tables; the parsing jobs then have to reproduce those views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.facts import METRIC_TAGS
from folioforge.plans import views as V

POSITION_HEADER = ["Symbol", "Quantity", "Mult", "Cost Price", "Cost Basis", "Close Price", "Value", "Unrealized P/L", "Code"]
TRADE_HEADER = ["Symbol", "Date/Time", "Quantity", "T. Price", "C. Price", "Proceeds", "Comm/Fee", "Basis", "Realized P/L", "Code"]
# Class, its label (one is cut off, as extraction tends to do) and its page.
CLASS_PAGES = [("STK", "Stocks", 10), ("ETF", "ETFs", 20), ("OPT", "Equity and Index Opt", 30)]
BUCKETS = 7


def _cells(values: list, width: int | None = None) -> Column:
    out = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.array(*(out + [F.lit("")] * ((width or len(out)) - len(out))))


def _row(page: int | Column, table: int, number: int | Column, cells: Column) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return F.struct(as_col(page).alias("page"), as_col(table).alias("table_no"), as_col(number).alias("row_no"), cells.alias("cells"))


def _number(col: str, digits: int) -> Column:
    return F.format_number(F.col(col), digits)


def statement_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of one file per yearly statement: account block and positions by class; trades by class.

    Data rows fall into seven fragments per class on consecutive pages. Fragments after the first
    have no header; they are one column short, and odd ones repeat the section name first, which
    makes them tables of their own.
    """
    base = V.trades_base(spark, sf_dir, V.written_lines(spark, sf_dir))
    positions, trades = V.positions(spark, sf_dir, base), V.trades(spark, sf_dir, base)
    width, twidth = len(POSITION_HEADER), len(TRADE_HEADER)
    files = V.statements(spark, sf_dir).where(~F.col("id").endswith("overlap")).select(
        F.col("id").alias("file_id"), "account_id", "period_start", "period_end")
    long_date = lambda c: F.date_format(c, "MMMM d, yyyy")
    frame = [
        _row(1, 1, 0, _cells(["Cover", "page"], 3)),
        _row(1, 2, 1, _cells(["Account Information"], 2)), _row(1, 2, 2, _cells(["Account", F.col("account_id")])),
        _row(1, 2, 3, _cells(["Base Currency", "SGD"])),
        _row(1, 3, 1, _cells(["Net Asset Value"], 4)),
        _row(1, 3, 2, _cells([long_date(F.date_sub("period_start", 1)), "", long_date(F.col("period_end")), ""])),
        _row(2, 1, 1, _cells(["Open Positions"], width)), _row(2, 1, 2, _cells(POSITION_HEADER)),
        _row(5, 1, 1, _cells(["Bonds"], width)), _row(5, 1, 2, _cells(["USD"], width)),
        _row(5, 1, 3, _cells(["ACME 5% 2030", "10", "1", "99", "990", "98", "980", "-10"], width)),
        _row(100, 1, 1, _cells(["Trades"], twidth)), _row(100, 1, 2, _cells(TRADE_HEADER)),
        _row(900, 1, 1, _cells(["Transaction Fees"], 4)), _row(900, 1, 2, _cells(["AAPL", "1", "2", "3"])),
    ]
    for _, label, page in CLASS_PAGES:
        for base, w in ((0, width), (100, twidth)):
            frame += [_row(base + page, 1, 1, _cells([label], w)), _row(base + page, 1, 2, _cells(["USD"], w))]
            frame += [_row(base + page + 9, 9, 1, _cells([f"Total {label}"], w))]
    for _, _, page in CLASS_PAGES:
        frame += [_row(page + b, 2, 0, _cells(["Open Positions"], width)) for b in range(1, BUCKETS, 2)]
    fixed = files.select("file_id", F.explode(F.array(*frame)).alias("r")).select("file_id", "r.*")

    class_page = F.when(F.col("asset_class") == "STK", 10).when(F.col("asset_class") == "ETF", 20).otherwise(30)
    bucket = F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int")
    spot = F.xxhash64("symbol", "cost_basis")

    def placed(df: DataFrame, base: int, cells: Column, number: Column) -> DataFrame:
        # Fragment 0 is the table that starts the class; the others lose the empty last column.
        cut = F.when(F.col("bucket") == 0, cells).otherwise(F.slice(cells, 1, F.size(cells) - 1))
        return df.withColumn("bucket", bucket).select(
            F.col("statement_id").alias("file_id"), (F.lit(base) + class_page + F.col("bucket")).cast("long").alias("page"),
            F.when(F.col("bucket") == 0, 1).otherwise(2).cast("long").alias("table_no"), number.alias("row_no"), cut.alias("cells"))

    number = F.shiftrightunsigned(spot, 2) + 10
    pos = placed(positions, 0, _cells([
        F.col("symbol"), _number("quantity", 4), "1", "", _number("cost_basis", 4), _number("market_price", 4),
        _number("market_value", 4), _number("unrealized_pnl", 4), "",
    ]), number)
    signed = F.when(F.col("side") == "BOT", F.col("quantity")).otherwise(-F.col("quantity"))
    trd = placed(trades.withColumn("signed", signed), 100, _cells([
        F.col("symbol"), F.date_format("trade_date", "yyyy-MM-dd,\nHH:mm:ss"), _number("signed", 4), _number("price", 4), "",
        _number("proceeds", 4), _number("commission", 6), "", _number("realized_pnl", 4), "",
    ]), F.shiftrightunsigned(F.xxhash64(*V.TRADE_COLUMNS), 2) + 10)
    return fixed.unionByName(pos), trd


def company_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One facts document per company: current values, an older filing of each, a 3-month context
    next to year-to-date ones, and facts of other forms that must not count."""
    m = V.stock_metrics(spark, sf_dir)
    tag = F.create_map(*[F.lit(x) for name, tags in METRIC_TAGS.items() for x in (name, tags[-1])])
    unit = F.when(F.col("metric_name").startswith("eps"), "USD/shares").when(
        F.col("metric_name") == "shares_outstanding", "shares").otherwise("USD")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    val = F.col("metric_value")

    def fact(value: Column, start: Column, form: Column, filed: Column) -> Column:
        return F.struct(
            value.cast("decimal(28,6)").alias("val"), day(start).alias("start"), day(F.col("period_end")).alias("end"),
            form.alias("form"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), day(filed).alias("filed"))

    filed = F.col("fetched_at")
    quarter_start = F.trunc("period_end", "quarter")
    ytd_quarter = F.col("fiscal_period").isin("Q2", "Q3") & (F.col("duration_days") > 100)
    entries = F.array_compact(F.array(
        fact(val, F.col("period_start"), F.col("filing_type"), filed),
        fact(val * F.expr("0.9"), F.col("period_start"), F.col("filing_type"), F.date_sub(filed, 20)),
        F.when(ytd_quarter, fact(val * F.expr("0.4"), quarter_start, F.col("filing_type"), F.date_add(filed, 30))),
        fact(val * F.expr("7"), F.col("period_start"), F.lit("8-K"), F.date_add(filed, 90)),
    ))
    tagged = m.select(
        "cik", F.substring_index(tag[F.col("metric_name")], ":", 1).alias("taxonomy"),
        F.substring_index(tag[F.col("metric_name")], ":", -1).alias("tag"), unit.alias("unit"), F.explode(entries).alias("e"))
    units = (
        tagged.groupBy("cik", "taxonomy", "tag", "unit").agg(F.collect_list("e").alias("facts"))
        .select("cik", "taxonomy", "tag", F.create_map("unit", "facts").alias("units"))
    )
    tags = units.groupBy("cik", "taxonomy").agg(
        F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units").alias("body")))).alias("tags"))
    facts = tags.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))
    return facts.select("cik", F.to_json(F.struct(
        F.col("cik").cast("long").alias("cik"), F.concat(F.lit("Company "), "cik").alias("entityName"), "facts")).alias("body"))


def ticker_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker rows for every company of the fundamentals view, in mixed case."""
    return V.stock_metrics(spark, sf_dir).select(
        F.lower("symbol").alias("ticker"), F.col("cik").cast("long").alias("cik_str")).distinct()
