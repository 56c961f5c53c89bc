import math
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioforge.functions import instruments as I
from folioforge.functions import text as X
from folioforge.functions.numeric import norm_cdf
from folioforge.operators import facts as A


def test_norm_cdf_matches_erf(spark):
    df = spark.range(-4000, 4001).select((F.col("id") / 400.0).alias("x"))
    rows = df.select("x", norm_cdf(F.col("x")).alias("n")).collect()
    assert max(abs(r.n - 0.5 * math.erfc(-r.x / math.sqrt(2))) for r in rows) < 1e-14
    assert spark.range(1).select(norm_cdf(F.lit(None).cast("double")).alias("n")).first().n is None


def test_delta_bounds_parity_and_nulls(spark):
    rows = spark.createDataFrame(
        [(s, k, t, v) for s in (50.0, 100.0, 180.0) for k in (90.0, 100.0) for t in (0.1, 1.0) for v in (0.1, 0.5)]
        + [(100.0, 100.0, 0.0, 0.3), (100.0, 0.0, 1.0, 0.3), (100.0, 100.0, 1.0, 0.0)],
        "s double, k double, t double, v double",
    )
    args = [F.col(c) for c in ("s", "k", "t", "v")]
    out = rows.select("t", "k", "v", I.option_delta(*args, F.lit("C")).alias("c"), I.option_delta(*args, F.lit("P")).alias("p")).collect()
    for r in out:
        if r.t > 0 and r.k > 0 and r.v > 0:
            assert 0 <= r.c <= 1 and -1 <= r.p <= 0 and r.c - r.p == pytest.approx(1.0)
        else:
            assert r.c is None and r.p is None


@pytest.mark.parametrize("symbol, expected", [
    ("EEM 31MAR26 48 C", (date(2026, 3, 31), Decimal("48"), "C")),
    ("PYPL 18SEP26 87.5 P", (date(2026, 9, 18), Decimal("87.5"), "P")),
    ("AAPL 20240119 150.0 C", (date(2024, 1, 19), Decimal("150"), "C")),
    ("AAPL  240119C00150000", (date(2024, 1, 19), Decimal("150"), "C")),
    ("X 5JAN97 10 p", (date(1997, 1, 5), Decimal("10"), "P")),
    ("WEIRD_SYMBOL", (None, None, None)),
    ("A 31MAR26 48 Z", (None, None, None)),
])
def test_option_symbols(spark, symbol, expected):
    r = spark.createDataFrame([(symbol,)], "s string").select(X.option_terms(F.col("s")).alias("t")).first().t
    assert (r.expiry, r.strike, r.right) == expected


def test_numbers_times_and_dates(spark):
    r = spark.createDataFrame([("1,234.50", "", "junk", "2026-01-12,\n09:30:00", "2026-01-12;09:30:00", "2026-01-12 x", "March 6, 2026", "Mar 6, 2026", "n/a")],
                              "a string, b string, c string, d string, e string, f string, g string, h string, i string")
    row = r.select(*[X.to_decimal(F.col(c)).alias(c) for c in "abc"], *[X.to_trade_time(F.col(c)).alias(c) for c in "def"],
                   *[X.to_period_date(F.col(c)).alias(c) for c in "ghi"]).first()
    assert (row.a, row.b, row.c) == (Decimal("1234.5"), 0, 0)
    assert row.d == row.e == datetime(2026, 1, 12, 9, 30) and row.f == datetime(2026, 1, 12)
    assert row.g == row.h == date(2026, 3, 6) and row.i is None


def test_durations(spark):
    cases = [("2024-01-01", "2024-03-31", "3mo"), ("2024-01-01", "2024-06-30", "6mo"), ("2024-01-01", "2024-09-30", "9mo"),
             ("2024-01-01", "2024-12-31", "12mo"), (None, "2024-12-31", "instant"), ("2024-01-01", "2024-01-01", "instant"),
             ("2020-01-01", "2024-01-01", "unknown"), ("bad", "2024-01-01", "unknown")]
    rows = spark.createDataFrame(cases, "s string, e string, want string").select(
        "want", A.duration_bucket(F.col("s"), F.col("e")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_option_position_terms(spark):
    r = spark.createDataFrame([(Decimal("200"), 195.0, Decimal("1000"), Decimal("-2"))], "k decimal(18,4), s double, c decimal(18,4), q decimal(18,4)")
    k, s, c, q = (F.col(x) for x in "kscq")
    row = r.select(
        I.moneyness(k, s, F.lit("C")).alias("mc"), I.moneyness(k, s, F.lit("P")).alias("mp"),
        I.moneyness_label(I.moneyness(k, s, F.lit("C"))).alias("label"),
        I.breakeven(k, c, q, F.lit("C")).alias("be"), I.days_to_expiry(F.lit(date(2026, 4, 17)), date(2026, 3, 25)).alias("dte"),
        I.underlying(F.lit("AAPL 20260417 200 C"), F.lit("OPT")).alias("u"), I.underlying(F.lit("BRK B"), F.lit("STK")).alias("v"),
    ).first()
    assert row.mc == pytest.approx(-0.025) and row.mp == pytest.approx(0.025) and row.label == "OTM"
    assert row.be == pytest.approx(195.0) and row.dte == 23 and row.u == "AAPL" and row.v == "BRK B"
