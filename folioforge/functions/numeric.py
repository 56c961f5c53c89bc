"""Null-safe arithmetic and the normal distribution as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """Quotient, or null when either side is null or the denominator is zero."""
    return F.try_divide(num, den)


def drop_zero(col: Column) -> Column:
    """Null when the value is zero (zero counts as missing in several rules)."""
    return F.when(col != 0, col)


def positive(col: Column) -> Column:
    return F.when(col > 0, col)


def clip(col: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null (least/greatest would skip it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def finite(col: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def _horner(x: Column, coefficients: list[float]) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


# Hart's rational approximation of the normal integral (published tables).
_HART_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
_HART_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
_HART_SPLIT = 7.07106781186547
_SQRT_2PI = 2.506628274631


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, accurate to double precision, without a UDF."""
    a = F.abs(x)
    density = F.exp(-a * a / 2.0)
    near = density * _horner(a, _HART_NUMERATOR) / _horner(a, _HART_DENOMINATOR)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    far = density / tail / F.lit(_SQRT_2PI)
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < _HART_SPLIT, near).otherwise(far)
    return F.when(x > 0, 1.0 - upper).when(x.isNotNull(), upper)
