"""Numeric helpers with pandas-like treatment of missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column | str) -> Column:
    """Tolerant parse: text that is no number, and NaN, become NULL."""
    n = F.trim(_col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(n), n)


def plain_number(c: Column | str) -> Column:
    """Tolerant parse of numbers written with thousands commas."""
    return to_number(F.regexp_replace(_col(c).cast("string"), ",", ""))


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(_col(c).cast("double"), digits)


def safe_rate(num: Column | str, den: Column | str, per: float = 1.0) -> Column:
    """num * per / den, and 0 where the quotient does not exist."""
    return F.coalesce(F.try_divide(_col(num) * F.lit(float(per)), _col(den)), F.lit(0.0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """Quotient of two measures in which 0 stands for missing; 0 where it does not exist."""
    top = F.nullif(_col(num).cast("double"), F.lit(0.0))
    return F.coalesce(F.try_divide(top, _col(den).cast("double")), F.lit(0.0))


def row_sum(cols: Sequence[str]) -> Column:
    """Sum over columns, missing ones skipped, 0 when all are missing."""
    return reduce(add, (F.coalesce(_col(c).cast("double"), F.lit(0.0)) for c in cols))


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over the columns that are present, NULL when none is."""
    known = reduce(add, (_col(c).isNotNull().cast("int") for c in cols))
    return F.try_divide(row_sum(cols), known)


def _col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c
