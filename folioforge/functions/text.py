"""Parsing of landed statement text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_decimal(text: Column) -> Column:
    """Number without thousands separators or line breaks; blanks and junk become 0."""
    cleaned = F.replace(F.replace(F.trim(text), F.lit(",")), F.lit("\n"))
    return F.coalesce(cleaned.try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))


def to_trade_time(text: Column) -> Column:
    """Statement time stamp in one of three layouts, else the leading date, else null."""
    flat = F.replace(F.trim(text), F.lit("\n"), F.lit(" "))
    as_ntz = lambda t: F.regexp_replace(t, "[,;] ?", " ").try_cast("timestamp_ntz")
    full = F.when(flat.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(, | |;)\d{1,2}:\d{1,2}:\d{1,2}$"), as_ntz(flat))
    day = F.when(F.substring(flat, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(flat, 1, 10).try_cast("timestamp_ntz"))
    return F.coalesce(full, day)


def _try_date(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(layout)).cast("date")


def _two_digit_year(day: Column) -> Column:
    """Two-digit years from 69 on belong to the last century."""
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def to_period_date(text: Column) -> Column:
    """ISO, 'March 6, 2026' or 'Mar 6, 2026'; null otherwise."""
    t = F.trim(text)
    return F.coalesce(*[_try_date(t, f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy")])


def _word(words: Column, back: int) -> Column:
    return F.try_element_at(words, F.lit(-back))


def _option_words(symbol: Column) -> Column:
    return F.split(F.trim(symbol), r"\s+")


def _short_day(words: Column) -> Column:
    """A day like 31MAR26 in the place of the expiry as seven characters; zeros if there is none."""
    return F.lpad(F.regexp_extract(_word(words, 3), r"^(\d{1,2}[A-Z]{3}\d{2})$", 1), 7, "0")


def _expiry(words: Column, short: Column) -> Column:
    month_day = F.concat(F.substring(short, 1, 2), F.initcap(F.lower(F.substring(short, 3, 3))), F.substring(short, 6, 2))
    word = _word(words, 3)
    return F.coalesce(
        F.when(short != "0000000", _two_digit_year(_try_date(month_day, "ddMMMyy"))),
        F.when(word.rlike(r"^\d{8}$"), _try_date(word, "yyyyMMdd")),
    )


def _strike(words: Column) -> Column:
    return _word(words, 2).try_cast("decimal(38,10)")


def _terms(symbol: Column, words: Column, expiry: Column, strike: Column) -> Column:
    n, right = F.size(words), F.upper(_word(words, 1))
    good_spaced = (n >= 4) & right.isin("C", "P") & expiry.isNotNull() & strike.isNotNull()
    compact = r"(\d{6})([CP])(\d{8})"
    is_compact = symbol.rlike(compact) & ~((n >= 4) & ~right.isin("C", "P"))
    compact_strike = F.regexp_extract(symbol, compact, 3).try_cast("decimal(38,10)") * F.expr("0.001")
    return F.struct(
        F.when(good_spaced, expiry).when(is_compact, _two_digit_year(_try_date(F.regexp_extract(symbol, compact, 1), "yyMMdd"))).alias("expiry"),
        F.when(good_spaced, strike).when(is_compact, compact_strike.cast("decimal(38,10)")).alias("strike"),
        F.when(good_spaced, right).when(is_compact, F.regexp_extract(symbol, compact, 2)).alias("right"),
    )


def option_terms(symbol: Column) -> Column:
    """struct(expiry, strike, right) of an option symbol; fields are null when it does not parse.

    Layouts: 'SYM 31MAR26 48 C', 'SYM 20240119 150.0 C' and the compact 'SYM  240119C00150000'.
    """
    words = _option_words(symbol)
    return _terms(symbol, words, _expiry(words, _short_day(words)), _strike(words))


def with_option_terms(df: DataFrame, symbol: Column) -> DataFrame:
    """The rows with :func:`option_terms` as ``terms``, in steps, so that each text is cut and parsed once per row."""
    words = F.col("__words")
    steps = {"__symbol": symbol, "__words": _option_words(F.col("__symbol")), "__short": _short_day(words),
             "__expiry": _expiry(words, F.col("__short")), "__strike": _strike(words),
             "terms": _terms(F.col("__symbol"), words, F.col("__expiry"), F.col("__strike"))}
    for name, step in steps.items():
        df = df.withColumn(name, step)
    return df.drop(*[name for name in steps if name != "terms"])
