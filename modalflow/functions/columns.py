"""Column helpers without Python code in the data path."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def rounded(x: Column | str, digits: int = 4) -> Column:
    """Rounded, without negative zero, so that two engines give one value."""
    return F.round(x, digits) + F.lit(0.0)


def angle(k: Column, t: Column, n: Column) -> Column:
    """2 pi k t / n with k t reduced modulo n, which keeps sines exact for long series."""
    return F.lit(2 * math.pi) * (F.pmod(k.cast("long") * t.cast("long"), n.cast("long")) / n)


def hann(t: Column, n: Column) -> Column:
    """Periodic Hann window."""
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * t / n)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (or either is null)."""
    return F.try_divide(a, b)


def four_decimals(x: Column) -> Column:
    """`%.4f`, or n/a for null and non-finite values."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit("n/a")).otherwise(F.format_string("%.4f", x))
