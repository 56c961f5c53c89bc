"""Valuation ratios, growth, daily ratio history, percentiles, scores and portfolio statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.numeric import as_double, clip, drop_zero, finite, positive, safe_div
from folioforge.functions.scores import weighted_mean
from folioforge.operators.fundamentals import (
    detect_splits, is_flow, latest_metrics, latest_trailing, normalize_splits, period_preference, trailing_series,
)
from folioforge.operators.lineage import written_once
from folioforge.operators.prices import latest_prices
from folioforge.operators.scans import rank_by_score
from folioforge.schemas import FLOW_METRICS, POINT_METRICS, SNAPSHOT_MEASURES

HISTORY_RATIOS = ["pe_ttm", "pb", "ps", "ev_ebitda"]
_LEAST_HISTORY = 4
GROWTH_METRICS = {"revenue": "revenue_growth", "eps_diluted": "eps_growth", "net_income": "net_income_growth"}

# Weights per preset and the category and direction of every scored ratio.
SCORE_PRESETS: dict[str, dict[str, float]] = {
    "Balanced": {"valuation": 0.30, "profitability": 0.25, "health": 0.20, "growth": 0.25},
    "Value": {"valuation": 0.45, "profitability": 0.20, "health": 0.20, "growth": 0.15},
    "Growth": {"valuation": 0.15, "profitability": 0.20, "health": 0.15, "growth": 0.50},
    "Quality": {"valuation": 0.15, "profitability": 0.40, "health": 0.30, "growth": 0.15},
}
SCORED_RATIOS: dict[str, dict[str, bool]] = {
    "valuation": {"pe_ttm": False, "pb": False, "ps": False, "ev_ebitda": False},
    "profitability": {"gross_margin": True, "operating_margin": True, "net_margin": True, "roe": True, "roa": True},
    "health": {"current_ratio": True, "interest_coverage": True, "cash_to_assets": True, "debt_to_equity": False},
    "growth": {"revenue_growth": True, "eps_growth": True, "net_income_growth": True},
}


def valuation_inputs(metrics: DataFrame) -> DataFrame:
    """One wide row per symbol: trailing value of flow metrics (raw where annual or unknown), latest points."""
    normalized = normalize_splits(metrics, detect_splits(metrics))
    trailing = latest_trailing(trailing_series(normalized.where(is_flow()), "normalized_value"))
    latest = latest_metrics(metrics).join(trailing, ["symbol", "metric_name"], "left")
    raw = as_double("metric_value")
    quarterly = is_flow() & (F.coalesce("fiscal_period", F.lit("")) != "") & (F.col("fiscal_period") != "FY")
    chosen = F.when(quarterly, F.coalesce("ttm_value", raw)).otherwise(raw)
    return latest.withColumn("chosen", chosen).groupBy("symbol").agg(*[
        F.max(F.when(F.col("metric_name") == m, F.col("chosen"))).alias(m) for m in FLOW_METRICS + POINT_METRICS
    ])


def ratios(inputs: DataFrame, price: str = "price") -> DataFrame:
    """All ratios of one wide input row per symbol with its price."""
    c = F.col
    eps = F.coalesce(drop_zero(c("eps_diluted")), c("eps_basic"))
    cap, ev = c("market_cap"), c("enterprise_value")
    paid = F.abs(drop_zero(c("dividends_paid")))
    return (
        inputs.withColumn("market_cap", c(price) * drop_zero(c("shares_outstanding")))
        .withColumn("enterprise_value", cap + c("total_liabilities") - c("cash_and_equivalents"))
        .withColumns({
            "pe_ttm": safe_div(c(price), positive(eps)),
            "pb": safe_div(cap, positive(c("stockholders_equity"))),
            "ps": safe_div(cap, positive(c("revenue"))),
            "ev_ebitda": safe_div(ev, positive(c("operating_income"))),
            "ev_revenue": safe_div(ev, positive(c("revenue"))),
            "earnings_yield": safe_div(c("net_income"), cap),
            "fcf_yield": safe_div(c("operating_income") - F.abs("capital_expenditures"), cap),
            "gross_margin": safe_div(c("gross_profit"), c("revenue")),
            "operating_margin": safe_div(c("operating_income"), c("revenue")),
            "net_margin": safe_div(c("net_income"), c("revenue")),
            "roe": safe_div(c("net_income"), c("stockholders_equity")),
            "roa": safe_div(c("net_income"), c("total_assets")),
            "debt_to_equity": safe_div(c("total_liabilities"), c("stockholders_equity")),
            "current_ratio": safe_div(c("current_assets"), c("current_liabilities")),
            "interest_coverage": safe_div(c("operating_income"), F.abs("interest_expense")),
            "cash_to_assets": safe_div(c("cash_and_equivalents"), c("total_assets")),
            "dividend_yield": safe_div(safe_div(paid, c("shares_outstanding")), c(price)),
            "payout_ratio": safe_div(paid, positive(c("net_income"))),
        })
        .drop(*FLOW_METRICS, *POINT_METRICS)
    )


def growth(metrics: DataFrame, years: int = 1) -> DataFrame:
    """Growth between the newest annual row and the newest one at least ``years`` fiscal years older.

    One year gives the simple rate, more years the compound rate over the actual days.
    """
    series = ["symbol", "metric_name"]
    annual = metrics.where(
        (F.col("fiscal_period") == "FY") & F.col("metric_name").isin(list(GROWTH_METRICS))
    ).select(*series, "period_end", as_double("metric_value").alias("v"))
    w = Window.partitionBy(*series)
    older = F.when(F.year("period_end") <= F.year("newest") - years, F.col("period_end"))
    ends = (
        annual.withColumn("newest", F.max("period_end").over(w)).groupBy(*series)
        .agg(
            F.max("newest").alias("new_at"), F.max_by("v", "period_end").alias("v_new"),
            F.max(older).alias("old_at"), F.max_by("v", older).alias("v_old"),
        )
        .where(F.col("v_old") > 0)
    )
    if years == 1:
        rate = (F.col("v_new") - F.col("v_old")) / F.abs("v_old")
    else:
        span = F.datediff("new_at", "old_at") / 365.25
        rate = F.when(F.col("v_new") > 0, F.pow(F.col("v_new") / F.col("v_old"), 1.0 / span) - 1)
    return ends.withColumn("growth", rate).groupBy("symbol").agg(*[
        F.max(F.when(F.col("metric_name") == m, F.col("growth"))).alias(name) for m, name in GROWTH_METRICS.items()
    ])


def peg(pe: Column, eps_growth: Column) -> Column:
    return safe_div(pe, positive(eps_growth * 100))


# --- daily history ----------------------------------------------------------------------------

_TTM_INPUTS = ["eps_diluted", "eps_basic", "revenue", "net_income", "operating_income"]
_POINT_INPUTS = ["shares_outstanding", "stockholders_equity", "total_assets", "total_liabilities", "cash_and_equivalents"]


def _facts_by_date(metrics: DataFrame, as_of_column: str) -> DataFrame:
    """(symbol, date) rows with the value that each input takes from that date on."""
    flows = trailing_series(metrics.where(F.col("metric_name").isin(_TTM_INPUTS)))
    known = flows.where(F.col("ttm_value").isNotNull()).select(
        "symbol", "metric_name", "fiscal_period", F.col(as_of_column).alias("day"), F.col("ttm_value").alias("v")
    )
    points = metrics.where(F.col("metric_name").isin(_POINT_INPUTS)).select(
        "symbol", "metric_name", "fiscal_period", F.col(as_of_column).alias("day"), as_double("metric_value").alias("v")
    )
    # Share counts implied by annual net income and EPS, used only by symbols without reported ones.
    annual = metrics.where((F.col("fiscal_period") == "FY") & F.col("metric_name").isin("net_income", "eps_diluted"))
    value = lambda m: F.max(F.when(F.col("metric_name") == m, as_double("metric_value")))
    implied = (
        annual.groupBy("symbol", F.col(as_of_column).alias("day"))
        .agg(safe_div(drop_zero(value("net_income")), value("eps_diluted")).alias("v"))
        .where(F.col("v") > 0)
        .select("symbol", F.lit("implied_shares").alias("metric_name"), F.lit("FY").alias("fiscal_period"), "day", "v")
    )
    names = _TTM_INPUTS + _POINT_INPUTS + ["implied_shares"]
    facts = known.unionByName(points).unionByName(implied)
    at = lambda m: F.when(F.col("metric_name") == m, period_preference())
    wide = facts.groupBy("symbol", "day").agg(*[F.max_by("v", at(m)).alias(m) for m in names])
    reports = F.max(F.col("shares_outstanding").isNotNull()).over(Window.partitionBy("symbol"))
    return wide.withColumn(
        "shares_outstanding", F.when(reports, F.col("shares_outstanding")).otherwise(F.col("implied_shares"))
    ).drop("implied_shares")


def ratio_history(metrics: DataFrame, prices: DataFrame, as_of_column: str = "period_end") -> DataFrame:
    """Daily valuation ratios: every bar with the most recent value of each input on or before it.

    All inputs are matched in one pass: facts and bars are laid on one time line per symbol and each
    input is carried forward, so the shuffle does not grow with the number of inputs.
    ``as_of_column`` may name another date (for example a filing date) to avoid look-ahead.
    """
    names = _TTM_INPUTS + _POINT_INPUTS
    facts = _facts_by_date(metrics, as_of_column).withColumns({"price": F.lit(None).cast("double"), "is_bar": F.lit(0)})
    bars = prices.select(
        "symbol", F.col("price_date").alias("day"), as_double("adj_close").alias("price"), F.lit(1).alias("is_bar")
    )
    line = Window.partitionBy("symbol").orderBy("day", "is_bar").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    carried = (
        facts.unionByName(bars, allowMissingColumns=True)
        .withColumns({n: F.last(n, ignorenulls=True).over(line) for n in names})
        .where((c("is_bar") == 1) & c("price").isNotNull() & (c("shares_outstanding") > 0))
    )
    cap = c("price") * c("shares_outstanding")
    ev = cap + c("total_liabilities") - c("cash_and_equivalents")
    eps = F.coalesce(drop_zero(c("eps_diluted")), c("eps_basic"))
    return carried.select(
        "symbol", c("day").alias("price_date"), "price",
        safe_div(c("price"), positive(eps)).alias("pe_ttm"),
        safe_div(cap, positive(c("stockholders_equity"))).alias("pb"),
        safe_div(cap, positive(c("revenue"))).alias("ps"),
        safe_div(drop_zero(ev), positive(c("operating_income"))).alias("ev_ebitda"),
    )


def percentile(below: Column, n: Column) -> Column:
    """Share of values below the current one, in percent; null for fewer than four values."""
    return F.when(n >= _LEAST_HISTORY, below / n * 100)


def history_summary(history: DataFrame) -> DataFrame:
    """Per symbol and ratio: current (last known) value, mean, range, count and percentile.

    The last values come from a window on the partitioning the history already has.
    """
    everything = Window.partitionBy("symbol").orderBy("price_date").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    tagged = history.withColumns({f"cur_{r}": F.last(r, ignorenulls=True).over(everything) for r in HISTORY_RATIOS})
    aggregates = []
    for r in HISTORY_RATIOS:
        aggregates.append(F.struct(
            F.lit(r).alias("ratio"), F.max(f"cur_{r}").alias("current"), F.avg(r).alias("mean"),
            F.min(r).alias("low"), F.max(r).alias("high"), F.count(r).alias("n"),
            F.count_if(F.col(r) < F.col(f"cur_{r}")).alias("below"),
        ).alias(f"s_{r}"))
    return (
        tagged.groupBy("symbol").agg(*aggregates)
        .select("symbol", F.explode(F.array(*[F.col(f"s_{r}") for r in HISTORY_RATIOS])).alias("s"))
        .select(
            "symbol", "s.ratio", "s.current", "s.mean", "s.low", "s.high", "s.n",
            percentile(F.col("s.below"), F.col("s.n")).alias("percentile"),
        )
    )


def _by_symbol(summary: DataFrame) -> DataFrame:
    cell = lambda r, col: F.max(F.when(F.col("ratio") == r, F.col(col)))
    return summary.groupBy("symbol").agg(
        *[cell(r, "current").alias(f"hist_{r}") for r in HISTORY_RATIOS],
        *[cell(r, "percentile").alias(f"{r}_pctl") for r in HISTORY_RATIOS],
        *[cell(r, "n").alias(f"n_{r}") for r in HISTORY_RATIOS],
    )


# --- score ------------------------------------------------------------------------------------


def score_absolute(value: Column, higher_is_better: bool) -> Column:
    """Logistic 0..100 mapping of a raw ratio."""
    if higher_is_better:
        score = 50.0 + 50.0 * (2.0 / (1.0 + F.exp(value * -8.0)) - 1.0)
    else:
        score = 100.0 - 50.0 * (2.0 / (1.0 + F.exp(value * -1.5)) - 1.0)
    return clip(score, 0.0, 100.0)


def score_percentile_inverted(value: Column) -> Column:
    return clip(100.0 - value, 0.0, 100.0)


def category_scores(rows: DataFrame) -> DataFrame:
    """Mean score of the available ratios of each category, as score_<category>."""
    out = {}
    for category, members in SCORED_RATIOS.items():
        parts = {
            r: score_percentile_inverted(F.col(f"{r}_pctl")) if category == "valuation" else score_absolute(F.col(r), up)
            for r, up in members.items()
        }
        out[f"score_{category}"] = weighted_mean(parts, {r: 1.0 for r in parts})
    return rows.withColumns(out)


def fundamental_scores(rows: DataFrame) -> DataFrame:
    """One row per symbol and preset with the composite; weights are renormalized over known categories."""
    categories = {k: F.col(f"score_{k}") for k in SCORED_RATIOS}
    presets = F.array(*[
        F.struct(F.lit(p).alias("preset"), weighted_mean(categories, w).alias("score_composite"))
        for p, w in SCORE_PRESETS.items()
    ])
    return category_scores(rows).withColumn("p", F.explode(presets)).withColumns({
        "preset": F.col("p.preset"), "score_composite": F.col("p.score_composite"),
    }).drop("p")


def valuation(metrics: DataFrame, prices: DataFrame, growth_years: int = 1, history_from: date | None = None) -> DataFrame:
    """Per symbol with metrics and a price, and per preset: ratios, growth, percentiles, scores.

    Where a ratio has a history, its last value replaces the spot computation, so that ratio,
    percentile and score agree.
    """
    spot = latest_prices(prices).select("symbol", as_double("adj_close").alias("price"))
    past = prices if history_from is None else prices.where(F.col("price_date") >= F.lit(history_from))
    history = _by_symbol(history_summary(ratio_history(metrics, past)))
    rows = (
        ratios(valuation_inputs(metrics).join(spot, "symbol"))
        .join(growth(metrics, growth_years), "symbol", "left")
        .join(history, "symbol", "left")
        .withColumns({r: F.coalesce(f"hist_{r}", r) for r in HISTORY_RATIOS})
        .withColumn("peg", peg(F.col("pe_ttm"), F.col("eps_growth")))
    )
    return fundamental_scores(rows)


# --- scores as of many days -------------------------------------------------------------------


def _period_of(day: Column, days: list[date]) -> Column:
    """Index of the first of the ascending ``days`` that is not before ``day``; their number where there is none."""
    return F.size(F.filter(F.array(*[F.lit(d) for d in days]), lambda d: d < day))


def facts_as_of(metrics: DataFrame, days: list[date], growth_years: int = 1) -> DataFrame:
    """(symbol, period, metric columns, growth columns): what was newest on each day, carried on from earlier days.

    A report counts from its period end; flows are trailing sums as in the ratio history, growth is that of the newest
    annual report. Values stay in the share basis in which they were reported.
    """
    flows = trailing_series(metrics.where(is_flow()))
    raw = as_double("metric_value")
    interim = (F.coalesce("fiscal_period", F.lit("")) != "") & (F.col("fiscal_period") != "FY")
    flow_facts = flows.select("symbol", "metric_name", "period_end", "fiscal_period", F.when(interim, F.coalesce("ttm_value", raw)).otherwise(raw).alias("v"))
    points = metrics.where(F.col("metric_name").isin(POINT_METRICS)).select("symbol", "metric_name", "period_end", "fiscal_period", raw.alias("v"))
    annual = metrics.where((F.col("fiscal_period") == "FY") & F.col("metric_name").isin(list(GROWTH_METRICS))).select(
        "symbol", "metric_name", "period_end", "fiscal_period", raw.alias("v"))
    older = Window.partitionBy("symbol", "metric_name").orderBy(F.year("period_end")).rangeBetween(Window.unboundedPreceding, -growth_years)
    before = F.max(F.struct(F.col("period_end").alias("at"), F.col("v").alias("old"))).over(older)
    span = F.datediff("period_end", "b.at") / 365.25
    simple = (F.col("v") - F.col("b.old")) / F.abs("b.old")
    rate = simple if growth_years == 1 else F.when(F.col("v") > 0, F.pow(F.col("v") / F.col("b.old"), 1.0 / span) - 1)
    names = F.create_map(*[F.lit(x) for pair in GROWTH_METRICS.items() for x in pair])
    grown = annual.withColumn("b", before).select(
        "symbol", names[F.col("metric_name")].alias("metric_name"), "period_end", "fiscal_period", F.when(F.col("b.old") > 0, rate).alias("v"))
    facts = flow_facts.unionByName(points).unionByName(grown).withColumns({
        "period": _period_of(F.col("period_end"), days),
        "order": F.datediff("period_end", F.lit(date(1970, 1, 1))) * 10 + period_preference(),
    }).where(F.col("period") < len(days))
    columns = FLOW_METRICS + POINT_METRICS + list(GROWTH_METRICS.values())
    of = lambda m: F.when(F.col("metric_name") == m, F.col("order"))
    known = facts.groupBy("symbol", "period").agg(
        *[F.max_by("v", of(m)).alias(f"v_{m}") for m in columns], *[F.max(of(m)).alias(f"at_{m}") for m in columns])
    grid = known.select("symbol").distinct().withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(len(days) - 1))))
    so_far = Window.partitionBy("symbol").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    # A newest report without a value (growth without an older year) hides the value before it.
    newest = lambda m: F.last(F.when(F.col(f"at_{m}").isNotNull(), F.struct(f"v_{m}")), ignorenulls=True).over(so_far)[f"v_{m}"]
    filled = grid.join(known, ["symbol", "period"], "left").withColumn("reported", F.count(F.greatest(*[f"at_{m}" for m in columns])).over(so_far))
    return filled.select("symbol", "period", "reported", *[newest(m).alias(m) for m in columns]).where("reported > 0").drop("reported")


def percentiles_as_of(history: DataFrame, days: list[date]) -> DataFrame:
    """(symbol, period, current and percentile of each history ratio) among all its values up to each day.

    No history is sorted, and none is read once per day: the current values of the days cut each ratio's range into cells, the
    history is counted once per (period, cell), and sums of these counts say how many values lie below. Exact, because
    the cuts are the values that are asked for. ``history`` is read twice.
    """
    placed = history.withColumn("period", _period_of(F.col("price_date"), days)).where(F.col("period") < len(days))
    at = lambda r: F.when(F.col(r).isNotNull(), F.col("price_date"))
    ends = placed.groupBy("symbol", "period").agg(*[F.max_by(r, at(r)).alias(r) for r in HISTORY_RATIOS])
    grid = ends.select("symbol").distinct().withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(len(days) - 1))))
    so_far = Window.partitionBy("symbol").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    current = grid.join(ends, ["symbol", "period"], "left").select(
        "symbol", "period", *[F.last(r, ignorenulls=True).over(so_far).alias(r) for r in HISTORY_RATIOS])
    cuts = current.groupBy("symbol").agg(*[F.array_sort(F.collect_set(r)).alias(f"cuts_{r}") for r in HISTORY_RATIOS])
    # Cell j holds the values from cut j - 1 up to below cut j.
    cell = lambda r: F.size(F.filter(F.col(f"cuts_{r}"), lambda c: c <= F.col(r)))
    cells = placed.join(cuts, "symbol").select("symbol", "period", F.inline(F.array(*[
        F.struct(F.lit(r).alias("ratio"), F.when(F.col(r).isNotNull(), cell(r)).alias("cell")) for r in HISTORY_RATIOS])))
    counted = cells.where(F.col("cell").isNotNull()).groupBy("symbol", "ratio", "period", "cell").agg(F.count("*").alias("n"))
    asked = current.join(cuts, "symbol").select("symbol", F.col("period").alias("upto"), F.inline(F.array(*[
        F.struct(F.lit(r).alias("ratio"), F.col(r).alias("current"), F.array_position(f"cuts_{r}", F.col(r)).alias("place")) for r in HISTORY_RATIOS]))
    ).where(F.col("current").isNotNull())
    summed = asked.join(counted, ["symbol", "ratio"]).where(F.col("period") <= F.col("upto")).groupBy("symbol", "upto", "ratio").agg(
        F.max("current").alias("current"), F.sum("n").alias("n"), F.sum(F.when(F.col("cell") < F.col("place"), F.col("n")).otherwise(0)).alias("below"))
    pick = lambda r, value: F.max(F.when(F.col("ratio") == r, value))
    return summed.groupBy("symbol", F.col("upto").alias("period")).agg(
        *[pick(r, F.col("current")).alias(f"hist_{r}") for r in HISTORY_RATIOS],
        *[pick(r, percentile(F.col("below"), F.col("n"))).alias(f"{r}_pctl") for r in HISTORY_RATIOS])


def score_history(metrics: DataFrame, prices: DataFrame, days: list[date], growth_years: int = 1) -> DataFrame:
    """Ratios, percentiles and scores of every symbol and preset as of each of the ``days``, in one plan.

    What later days know is not used: prices, reports and the values that percentiles are taken among end on the day.
    """
    days = sorted(set(days))
    if not days:
        raise ValueError("no days")
    history = written_once(ratio_history(metrics, prices))
    bars = prices.select("symbol", _period_of(F.col("price_date"), days).alias("period"), "price_date", as_double("adj_close").alias("close"))
    closes = bars.where(F.col("period") < len(days)).groupBy("symbol", "period").agg(F.max_by("close", "price_date").alias("close"))
    so_far = Window.partitionBy("symbol").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    known = facts_as_of(metrics, days, growth_years).join(closes, ["symbol", "period"], "full").withColumns({
        "price": F.last("close", ignorenulls=True).over(so_far), "known": F.coalesce(*FLOW_METRICS, *POINT_METRICS).isNotNull()})
    rows = ratios(known.where(F.col("price").isNotNull() & F.col("known")).drop("close", "known"))
    rows = rows.join(percentiles_as_of(history, days), ["symbol", "period"], "left").withColumns(
        {r: F.coalesce(f"hist_{r}", r) for r in HISTORY_RATIOS})
    day_of = F.get(F.array(*[F.lit(d) for d in days]), F.col("period"))
    valued = rows.withColumns({"peg": peg(F.col("pe_ttm"), F.col("eps_growth")), "snapshot_date": day_of})
    return fundamental_scores(valued).drop("period", *[f"hist_{r}" for r in HISTORY_RATIOS])


def snapshots(valued: DataFrame, day: date) -> DataFrame:
    """Rows for the snapshot table: finite values, 6 decimals, one row per (symbol, date, preset)."""
    names = {"pe_percentile": "pe_ttm_pctl", "pb_percentile": "pb_pctl", "ps_percentile": "ps_pctl",
             "ev_ebitda_percentile": "ev_ebitda_pctl"}
    keep = lambda col: F.bround(finite(F.col(col)), 6).cast("decimal(38,10)")
    return valued.select(
        "symbol", F.lit(day).alias("snapshot_date"), "preset", keep("price").alias("price_used"),
        *[keep(names.get(m, m)).alias(m) for m in SNAPSHOT_MEASURES],
    )


def missing_history(valued: DataFrame) -> DataFrame:
    """Symbols without any percentile, with the number of history values per ratio."""
    no_percentile = F.coalesce(*[F.col(f"{r}_pctl") for r in HISTORY_RATIOS]).isNull()
    return valued.where(no_percentile).select(
        "symbol", *[F.coalesce(f"n_{r}", F.lit(0)).alias(f"n_{r}") for r in HISTORY_RATIOS]
    ).distinct()


# Bits of ``present`` in :func:`coverage`.
HAS_PRICES, HAS_METRICS, HAS_SHARES = 1, 2, 4


def coverage(metrics: DataFrame, prices: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """What is known of every symbol of any source, from one aggregation over their union.

    Columns: rows of bars (with first and last day) and of metrics, share counts, values of each history ratio, ``present`` (bit
    mask) and ``missing``: prices, metrics, shares, or the history ratios with too few values for a percentile.
    ``symbols`` names more of them (for example those held), which may be in no other source.
    """
    history = ratio_history(metrics, prices)
    zero = F.lit(0)
    counts = ["n_bars", "n_metrics", "n_shares", *[f"n_{r}" for r in HISTORY_RATIOS]]

    def counted(df: DataFrame, day: Column | None = None, **ones: Column) -> DataFrame:
        return df.select("symbol", (F.lit(None).cast("date") if day is None else day).alias("day"), *[ones.get(c, zero).cast("long").alias(c) for c in counts])

    parts = [
        counted(prices, F.col("price_date"), n_bars=F.lit(1)),
        counted(metrics, n_metrics=F.lit(1), n_shares=(F.col("metric_name") == "shares_outstanding").cast("long")),
        counted(history, **{f"n_{r}": F.col(r).isNotNull().cast("long") for r in HISTORY_RATIOS}),
    ]
    if symbols is not None:
        parts.append(counted(symbols))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    summed = everything.groupBy("symbol").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), *[F.sum(c).alias(c) for c in counts])
    mask = lambda c, bit: F.when(F.col(c) > 0, bit).otherwise(0)
    lacking = {"prices": "n_bars", "metrics": "n_metrics", "shares": "n_shares"}
    missing = F.array_compact(F.array(
        *[F.when(F.col(c) == 0, name) for name, c in lacking.items()],
        *[F.when(F.col(f"n_{r}") < _LEAST_HISTORY, r) for r in HISTORY_RATIOS]))
    return summed.withColumns({
        "present": mask("n_bars", HAS_PRICES) + mask("n_metrics", HAS_METRICS) + mask("n_shares", HAS_SHARES), "missing": missing})


def score_table(valued: DataFrame) -> DataFrame:
    """Scores rounded to one decimal and ranked within each preset."""
    rounded = valued.select(
        "symbol", "preset",
        *[F.bround(c, 1).alias(c) for c in ["score_composite"] + [f"score_{k}" for k in SCORED_RATIOS]],
    )
    return rank_by_score(rounded, "score_composite", "symbol", "rank", groups=["preset"])


# --- portfolio --------------------------------------------------------------------------------

WEIGHTED_RATIOS = ["pe_ttm", "pb", "ps", "earnings_yield", "dividend_yield"]


def portfolio_stats(positions: DataFrame, ratio_rows: DataFrame, scope: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Value-weighted ratios, earnings yield on cost and concentration over stock and ETF rows with ratios.

    ``ratio_rows`` has one row per symbol.
    """
    from folioforge.operators.holdings import concentration_label
    from folioforge.operators.scans import share_of_total

    held = positions.where(F.col("asset_class").isin("STK", "ETF")).select(
        *scope, "symbol", F.abs(as_double("market_value")).alias("mv"), F.abs(as_double("cost_basis")).alias("cost"),
    )
    valid = share_of_total(held.join(ratio_rows.select("symbol", *WEIGHTED_RATIOS), "symbol"), "mv", "share", scope)
    mv = F.col("mv")

    def weighted(r: str) -> Column:
        v = finite(F.col(r))
        return safe_div(F.sum(v * mv), positive(F.sum(F.when(v.isNotNull(), mv)))).alias(f"weighted_{r}")

    earned = F.coalesce(F.sum(F.col("earnings_yield") * mv), F.lit(0.0))
    return (
        valid.groupBy(*scope)
        .agg(
            *[weighted(r) for r in WEIGHTED_RATIOS],
            safe_div(earned, positive(F.sum("cost"))).alias("earnings_yield_on_cost"),
            F.sum(F.col("share") * F.col("share")).alias("herfindahl"),
            F.max("share").alias("top_holding_pct"), F.count("*").alias("num_holdings"),
        )
        .where(F.col("herfindahl").isNotNull())
        .withColumn("label", concentration_label(F.col("herfindahl")))
    )
