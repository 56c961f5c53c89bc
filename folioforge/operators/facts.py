"""Company-facts documents -> long metrics, for all companies in one job.

A document is one row. Tag choice, unit choice, form filter and style detection are expressions on
its nested arrays, so nothing is shuffled until the reported facts are deduplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.keyed import first_per_key

# Tags per metric in order of preference.
METRIC_TAGS: dict[str, list[str]] = {
    "revenue": [
        "us-gaap:Revenues", "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax",
        "us-gaap:SalesRevenueNet", "us-gaap:RevenueFromContractWithCustomerIncludingAssessedTax",
    ],
    "net_income": ["us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss"],
    "eps_basic": ["us-gaap:EarningsPerShareBasic"],
    "eps_diluted": ["us-gaap:EarningsPerShareDiluted"],
    "total_assets": ["us-gaap:Assets"],
    "total_liabilities": ["us-gaap:Liabilities"],
    "stockholders_equity": [
        "us-gaap:StockholdersEquity",
        "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "shares_outstanding": ["us-gaap:CommonStockSharesOutstanding", "dei:EntityCommonStockSharesOutstanding"],
    "operating_income": ["us-gaap:OperatingIncomeLoss"],
    "cash_and_equivalents": ["us-gaap:CashAndCashEquivalentsAtCarryingValue", "us-gaap:Cash"],
    "gross_profit": ["us-gaap:GrossProfit"],
    "current_assets": ["us-gaap:AssetsCurrent"],
    "current_liabilities": ["us-gaap:LiabilitiesCurrent"],
    "long_term_debt": ["us-gaap:LongTermDebt", "us-gaap:LongTermDebtNoncurrent"],
    "capital_expenditures": [
        "us-gaap:PaymentsToAcquirePropertyPlantAndEquipment", "us-gaap:CapitalExpenditureDiscontinuedOperations",
    ],
    "dividends_paid": ["us-gaap:PaymentsOfDividends", "us-gaap:PaymentsOfDividendsCommonStock"],
    "interest_expense": ["us-gaap:InterestExpense", "us-gaap:InterestExpenseDebt"],
}
# Units in order of preference, accepted forms, ticker aliases.
UNITS = ["USD", "shares", "USD/shares", "pure"]
FORMS = ["10-K", "10-Q"]
TICKER_ALIASES = {"GOOG": "GOOGL", "BRK.A": "BRK-A", "BRK/A": "BRK-A", "BRK.B": "BRK-B", "BRK/B": "BRK-B"}

FACT_FIELDS = "val string, start string, end string, form string, fy string, fp string, filed string"
DOCUMENT_SCHEMA = (
    "cik bigint, entityName string, "
    f"facts map<string, map<string, struct<units: map<string, array<struct<{FACT_FIELDS.replace(' string', ': string')}>>>>>>"
)


def _day(text: Column) -> Column:
    return text.try_cast("date")


def duration_days(start: Column, end: Column) -> Column:
    """Days between two ISO dates; null when one is missing or malformed."""
    return F.datediff(_day(end), _day(start))


def duration_bucket(start: Column, end: Column) -> Column:
    """'3mo', '6mo', '9mo', '12mo', 'instant' or 'unknown'."""
    blank = (F.coalesce(start, F.lit("")) == "") | (F.coalesce(end, F.lit("")) == "")
    days = duration_days(start, end)
    # Upper bounds in days.
    return (
        F.when(blank | (days <= 0), "instant").when(days <= 100, "3mo").when(days <= 200, "6mo")
        .when(days <= 290, "9mo").when(days <= 400, "12mo").otherwise("unknown")
    )


def reporting_style(entries: Column) -> Column:
    """How an array of facts reports its second and third quarters."""
    middle = lambda e: e["fp"].isin("Q2", "Q3")
    bucket = lambda e: duration_bucket(e["start"], e["end"])
    short = F.exists(entries, lambda e: F.coalesce(middle(e) & (bucket(e) == "3mo"), F.lit(False)))
    long = F.exists(entries, lambda e: F.coalesce(middle(e) & bucket(e).isin("6mo", "9mo"), F.lit(False)))
    quarterly = F.exists(entries, lambda e: F.coalesce(e["fp"].isin("Q1", "Q2", "Q3", "Q4"), F.lit(False)))
    return (
        F.when(short & long, "mixed").when(long, "cumulative_ytd").when(short, "standalone_quarterly")
        .when(quarterly, "cumulative_ytd").otherwise("annual_only")
    )


def _filed_forms(entries: Column) -> Column:
    return F.filter(entries, lambda e: F.coalesce(e["form"].isin(FORMS), F.lit(False)))


def _tag_entries(facts: Column, tag: str) -> Column:
    """Facts of one tag in its preferred unit; null when there is none with a period end."""
    taxonomy, name = tag.split(":", 1)
    units = F.try_element_at(F.try_element_at(facts, F.lit(taxonomy)), F.lit(name))["units"]
    chosen = F.coalesce(*[F.try_element_at(units, F.lit(u)) for u in UNITS])
    return F.when(F.exists(chosen, lambda e: F.coalesce(e["end"], F.lit("")) != ""), chosen)


def parse_documents(documents: DataFrame) -> DataFrame:
    """Documents (cik, body) -> one row per (cik, metric) with its facts and both styles."""
    parsed = documents.select("cik", F.from_json("body", DOCUMENT_SCHEMA).alias("d")).select("cik", "d.facts")
    series = F.array(*[
        F.struct(
            F.lit(metric).alias("metric_name"),
            F.coalesce(*[_tag_entries(F.col("facts"), t) for t in tags]).alias("entries"),
        )
        for metric, tags in METRIC_TAGS.items()
    ])
    return (
        parsed.select("cik", F.filter(series, lambda s: s["entries"].isNotNull()).alias("series"))
        .withColumn(
            "reporting_style",
            reporting_style(F.flatten(F.transform("series", lambda s: _filed_forms(s["entries"])))),
        )
        .select("cik", "reporting_style", F.explode("series").alias("s"))
        .select("cik", "reporting_style", "s.metric_name", "s.entries", _filed_forms(F.col("s.entries")).alias("filed_forms"))
        .withColumn("candidates", F.when(F.size("filed_forms") > 0, F.col("filed_forms")).otherwise(F.col("entries")))
        .withColumn("metric_style", reporting_style(F.col("candidates")))
        .drop("entries", "filed_forms")
    )


def company_styles(documents: DataFrame) -> DataFrame:
    return parse_documents(documents).select("cik", "reporting_style").distinct()


def facts_to_rows(documents: DataFrame) -> DataFrame:
    """One fact per (cik, metric, end, fiscal period): year-to-date over 3-month contexts where the
    metric is reported cumulatively, then the latest filing, then the longer period."""
    rows = (
        parse_documents(documents)
        .select("cik", "reporting_style", "metric_name", "metric_style", F.explode("candidates").alias("e"))
        .select("cik", "reporting_style", "metric_name", "metric_style", "e.*")
        .where(F.coalesce("end", F.lit("")) != "")
    )
    bucket = duration_bucket(F.col("start"), F.col("end"))
    prefers_ytd = F.col("fp").isin("Q2", "Q3") & F.col("metric_style").isin("cumulative_ytd", "mixed")
    return first_per_key(rows, ["cik", "metric_name", "end", "fp"], [
        F.coalesce(prefers_ytd & (bucket == "3mo"), F.lit(False)).asc(),
        F.col("filed").desc_nulls_last(),
        duration_days(F.col("start"), F.col("end")).desc_nulls_last(),
        F.col("val").desc_nulls_last(),
    ])


def ticker_ciks(ticker_map: DataFrame) -> DataFrame:
    """Ticker map rows (ticker, cik_str) -> upper-case ticker and zero-padded CIK."""
    return ticker_map.select(
        F.upper(F.trim("ticker")).alias("ticker"), F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik")
    ).where((F.col("ticker") != "") & F.col("cik").isNotNull())


def resolve_ciks(symbols: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Symbols with their CIK; aliases count only when the direct lookup misses. Unknown ones stay null."""
    alias = F.create_map(*[F.lit(x) for pair in TICKER_ALIASES.items() for x in pair])
    wanted = symbols.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    known = ticker_ciks(ticker_map)
    direct = known.withColumnsRenamed({"ticker": "symbol", "cik": "direct_cik"})
    other = known.withColumnsRenamed({"ticker": "alias", "cik": "alias_cik"})
    return (
        wanted.join(direct, "symbol", "left").withColumn("alias", F.try_element_at(alias, F.col("symbol")))
        .join(other, "alias", "left")
        .select("symbol", F.coalesce("direct_cik", "alias_cik").alias("cik"))
    )


def facts_to_metrics(symbols: DataFrame, ticker_map: DataFrame, documents: DataFrame) -> DataFrame:
    """Metrics table rows of the requested symbols; unparsable values and dates are left null.

    Split the result with the metric rules into accepted and quarantined rows.
    """
    end = F.col("period_end")
    resolved = resolve_ciks(symbols, ticker_map).where(F.col("cik").isNotNull())
    return (
        facts_to_rows(documents).join(resolved, "cik")
        .withColumns({
            "period_end": _day(F.col("end")), "period_start": _day(F.col("start")),
            "metric_value": F.col("val").try_cast("decimal(38,10)"),
            "duration_days": duration_days(F.col("start"), F.col("end")),
        })
        .select(
            "symbol", "metric_name", "metric_value", "period_end", "period_start",
            F.col("fp").alias("fiscal_period"),
            F.coalesce(F.col("fy").try_cast("int"), F.year(end)).alias("fiscal_year"),
            "duration_days", "reporting_style", F.lit("SEC_EDGAR").alias("source"), "cik",
            F.coalesce("form", F.lit("unknown")).alias("filing_type"),
        )
    )
