"""Table schemas, keys and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC = T.DecimalType(38, 10)


def _struct(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in spec])


# Statement times carry no zone, in the tables as in the views.
_S, _D, _TS, _I, _L = T.StringType(), T.DateType(), T.TimestampNTZType(), T.IntegerType(), T.LongType()
_OPTION_FIELDS = [("expiry", _D), ("strike", NUMERIC), ("right", _S)]

STATEMENTS = _struct([
    ("id", _S), ("account_id", _S), ("period_start", _D), ("period_end", _D),
    ("base_currency", _S), ("created_at", _TS),
])
POSITIONS = _struct([
    ("statement_id", _S), ("symbol", _S), ("asset_class", _S), ("quantity", NUMERIC),
    ("cost_basis", NUMERIC), ("market_price", NUMERIC), ("market_value", NUMERIC),
    ("unrealized_pnl", NUMERIC), ("currency", _S), ("statement_date", _D), *_OPTION_FIELDS,
    ("account_id", _S), ("created_at", _TS),
])
TRADES = _struct([
    ("statement_id", _S), ("trade_date", _TS), ("symbol", _S), ("asset_class", _S), ("side", _S),
    ("quantity", NUMERIC), ("price", NUMERIC), ("proceeds", NUMERIC), ("commission", NUMERIC),
    ("realized_pnl", NUMERIC), ("currency", _S), *_OPTION_FIELDS, ("account_id", _S),
])
STOCK_METRICS = _struct([
    ("symbol", _S), ("metric_name", _S), ("metric_value", NUMERIC), ("period_end", _D),
    ("period_start", _D), ("fiscal_period", _S), ("fiscal_year", _I), ("duration_days", _I),
    ("reporting_style", _S), ("source", _S), ("cik", _S), ("filing_type", _S), ("fetched_at", _TS),
])
DAILY_PRICES = _struct([
    ("symbol", _S), ("price_date", _D), ("open", NUMERIC), ("high", NUMERIC), ("low", NUMERIC),
    ("close", NUMERIC), ("adj_close", NUMERIC), ("volume", _L),
])
SNAPSHOT_MEASURES = [
    "pe_ttm", "pb", "ps", "ev_ebitda", "ev_revenue", "peg", "earnings_yield", "fcf_yield",
    "market_cap", "enterprise_value", "gross_margin", "operating_margin", "net_margin", "roe",
    "roa", "debt_to_equity", "current_ratio", "interest_coverage", "cash_to_assets",
    "dividend_yield", "payout_ratio", "revenue_growth", "eps_growth", "net_income_growth",
    "pe_percentile", "pb_percentile", "ps_percentile", "ev_ebitda_percentile",
    "score_composite", "score_valuation", "score_profitability", "score_health", "score_growth",
]
VALUATION_SNAPSHOTS = _struct(
    [("symbol", _S), ("snapshot_date", _D), ("preset", _S), ("price_used", NUMERIC)]
    + [(m, NUMERIC) for m in SNAPSHOT_MEASURES]
)

TABLES: dict[str, T.StructType] = {
    "statements": STATEMENTS,
    "positions": POSITIONS,
    "trades": TRADES,
    "stock_metrics": STOCK_METRICS,
    "daily_prices": DAILY_PRICES,
    "valuation_snapshots": VALUATION_SNAPSHOTS,
}

KEYS: dict[str, list[str]] = {
    "statements": ["account_id", "period_start", "period_end"],
    "stock_metrics": ["symbol", "metric_name", "period_end", "fiscal_period"],
    "daily_prices": ["symbol", "price_date"],
    "valuation_snapshots": ["symbol", "snapshot_date", "preset"],
}

POSITION_KEY = ["symbol", "expiry", "strike", "right"]
TRADE_FINGERPRINT = ["trade_date", "symbol", "asset_class", "side", "quantity", "price"]
POSITION_FINGERPRINT = ["symbol", "asset_class", "statement_date", "expiry", "strike", "right"]

# Fixed values of the data model.
ASSET_CLASSES = ["STK", "OPT", "ETF"]
SIDES = ["BOT", "SLD"]
RIGHTS = ["C", "P"]
OPTION_MULTIPLIER = 100
FLOW_METRICS = [
    "revenue", "net_income", "eps_basic", "eps_diluted", "operating_income", "gross_profit",
    "capital_expenditures", "dividends_paid", "interest_expense",
]
POINT_METRICS = [
    "total_assets", "total_liabilities", "stockholders_equity", "shares_outstanding",
    "cash_and_equivalents", "current_assets", "current_liabilities", "long_term_debt",
]
PER_SHARE_METRICS = ["eps_basic", "eps_diluted"]
SHARE_COUNT_METRICS = ["shares_outstanding"]
VALUATION_PRESETS = ["Balanced", "Value", "Growth", "Quality"]
