"""Instrument-level expressions: underlying, multiplier, option terms and greeks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.numeric import as_double, norm_cdf, safe_div
from folioforge.schemas import OPTION_MULTIPLIER

# Fixed values.
RISK_FREE_RATE = 0.045
DEFAULT_VOLATILITY = 0.30
DAYS_PER_YEAR = 365.0
MONEYNESS_BAND = 0.01


def is_option(asset_class: Column | str = "asset_class") -> Column:
    return (F.col(asset_class) if isinstance(asset_class, str) else asset_class) == "OPT"


def underlying(symbol: Column | str = "symbol", asset_class: Column | str = "asset_class") -> Column:
    """Ticker that carries the price: text before the first space for options, else the symbol."""
    sym = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.when(is_option(asset_class), F.substring_index(sym, " ", 1)).otherwise(sym)


def first_token(symbol: Column | str = "symbol") -> Column:
    """First whitespace-separated token of any symbol."""
    sym = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.regexp_extract(sym, r"^\s*(\S+)", 1)


def multiplier(asset_class: Column | str = "asset_class") -> Column:
    return F.when(is_option(asset_class), F.lit(OPTION_MULTIPLIER)).otherwise(F.lit(1))


def signed_quantity(side: Column | str = "side", quantity: Column | str = "quantity") -> Column:
    """+quantity for buys, -quantity for everything else."""
    q = F.col(quantity) if isinstance(quantity, str) else quantity
    s = F.col(side) if isinstance(side, str) else side
    return F.when(s == "BOT", q).otherwise(-q)


def position_key(columns: tuple[str, ...] = ("symbol", "expiry", "strike", "right")) -> list[Column]:
    """Key columns of a holding: option terms count only for options."""
    symbol, *terms = columns
    return [F.col(symbol)] + [F.when(is_option(), F.col(t)).alias(t) for t in terms]


def days_to_expiry(expiry: Column | str, as_of: date | Column) -> Column:
    day = F.lit(as_of) if isinstance(as_of, date) else as_of
    return F.datediff(F.col(expiry) if isinstance(expiry, str) else expiry, day)


def moneyness(strike: Column, price: Column, right: Column) -> Column:
    """Fraction in the money; the intrinsic direction depends on the right."""
    k, s = as_double(strike), as_double(price)
    gap = F.when(right == "C", s - k).when(right.isNotNull(), k - s)
    return safe_div(gap, k)


def moneyness_label(value: Column) -> Column:
    return (
        F.when(value > MONEYNESS_BAND, "ITM").when(value < -MONEYNESS_BAND, "OTM")
        .when(value.isNotNull(), "ATM").otherwise("N/A")
    )


def breakeven(strike: Column, cost: Column, quantity: Column, right: Column) -> Column:
    """Option breakeven: strike shifted by the premium per share (quantity keeps its sign)."""
    premium = safe_div(as_double(cost) / OPTION_MULTIPLIER, as_double(quantity))
    return F.when(right == "C", as_double(strike) + premium).when(
        right.isNotNull(), as_double(strike) - premium
    )


def holding_breakeven(
    asset_class: Column, strike: Column, cost: Column, quantity: Column, right: Column
) -> Column:
    """Breakeven of any holding from unsigned cost and quantity (average cost for non-options)."""
    per_unit = safe_div(F.abs(as_double(cost)), F.abs(as_double(quantity)))
    premium = per_unit / OPTION_MULTIPLIER
    return (
        F.when(~is_option(asset_class), per_unit)
        .when(right == "C", as_double(strike) + premium)
        .otherwise(as_double(strike) - premium)
    )


def option_delta(
    spot: Column, strike: Column, years: Column, sigma: Column, right: Column,
    rate: float = RISK_FREE_RATE, dividend_yield: float = 0.0,
) -> Column:
    """Black-Scholes delta; null unless spot, strike, time and volatility are all positive."""
    s, k, t, v = (as_double(c) for c in (spot, strike, years, sigma))
    usable = (s > 0) & (k > 0) & (t > 0) & (v > 0)
    d1 = (F.ln(s / k) + (F.lit(rate - dividend_yield) + v * v * 0.5) * t) / (v * F.sqrt(t))
    carry = F.exp(t * F.lit(-dividend_yield))
    n = norm_cdf(d1)
    return F.when(usable, carry * F.when(right == "C", n).otherwise(n - 1.0))


def option_beta(
    beta: Column, spot: Column, option_price: Column, delta: Column
) -> Column:
    """Elasticity-adjusted beta of an option; null when beta or delta is null or the price is not positive."""
    price = as_double(option_price)
    return F.when(price > 0, as_double(beta) * delta * as_double(spot) / price)
