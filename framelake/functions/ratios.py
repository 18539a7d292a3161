"""Division with an explicit policy for an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZERO, NULL, NAN = "zero", "null", "nan"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, on_zero: str = ZERO) -> Column:
    """``num / den``; an empty denominator gives 0, NULL or NaN as asked."""
    n, d = col(num).cast("double"), col(den).cast("double")
    empty = {ZERO: F.lit(0.0), NULL: F.lit(None).cast("double"), NAN: F.lit(float("nan"))}[on_zero]
    return F.when(d != 0, n / d).otherwise(empty)


def finite(c: Column | str) -> Column:
    """NULL for NaN and both infinities, so that aggregates skip them."""
    c = col(c)
    big = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (c != big) & (c != -big), c)


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)
