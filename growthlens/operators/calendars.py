"""Time spines, densifying, changes of frequency, calendar features."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from growthlens.operators.aggregates import bounds
from growthlens.operators.common import join_back, q, qs
from growthlens.operators.series import interpolate

_STEP = {"month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year", "day": "interval 1 day"}


def _edge(value: Any, fallback: Column | None) -> Column:
    if value is None:
        return fallback
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def _steps(lo: Column, hi: Column, unit: str) -> Column:
    if unit == "number":
        return F.sequence(lo, hi)
    return F.sequence(lo, hi, F.expr(_STEP[unit]))


def _next(c: Column, unit: str, n: int = 1) -> Column:
    if unit == "number":
        return c + F.lit(n)
    months = {"month": 1, "quarter": 3, "year": 12}
    return F.date_add(c, n) if unit == "day" else F.add_months(c, n * months[unit])


def spine(df: DataFrame, *, time: str, keys: Sequence[str], unit: str = "month", start: Any = None, end: Any = None) -> DataFrame:
    """Every step from start to end for every key of `df`.

    The calendar is generated per distinct key row; there is no cross join. `start` and `end` take a date or a column
    (a scalar subquery); they default to the bounds of the whole frame.
    """
    known = bounds(df, time) if start is None or end is None else None
    base = df.select(*qs(keys)).distinct()
    return _explode_calendar(base, time, unit, start, end, known)


def future_calendar(keys_df: DataFrame, *, time: str, unit: str, start: Any, end: Any) -> DataFrame:
    """Steps from start to end for every row of a table of keys (or keys with values to carry)."""
    return _explode_calendar(keys_df, time, unit, start, end, None)


def _explode_calendar(base, time, unit, start, end, known):
    if known is not None:
        base = base.withColumn("__b", known)
    as_edge = (lambda v, f: v if v is None or isinstance(v, Column) else F.lit(v)) if unit == "number" else _edge
    lo = as_edge(start, None) if start is not None else q("__b")["lo"]
    hi = as_edge(end, None) if end is not None else q("__b")["hi"]
    base = base.withColumns({"__lo": lo, "__hi": hi})
    base = base.where(q("__lo") <= q("__hi"))
    return base.withColumn(time, F.explode(_steps(q("__lo"), q("__hi"), unit))).drop("__lo", "__hi", "__b")


def _on_grid(lo: Column, c: Column, unit: str) -> Column:
    """Whether a value is a whole number of steps from the lower bound."""
    if unit in ("number", "day"):
        return F.lit(True) if unit == "day" else (c - lo) % 1 == 0
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    n = (F.year(c) - F.year(lo)) * 12 + F.month(c) - F.month(lo)
    return (n % months == 0) & (F.add_months(lo, n) == c)


def densify(
    df: DataFrame, *, time: str, keys: Sequence[str], unit: str = "month", start: Any = None, end: Any = None
) -> DataFrame:
    """Insert a row of missing values for every calendar step a series lacks.

    Each row emits itself and the steps up to its successor; the first and last also those up to the frame's bounds.
    That needs no join with a spine and leaves rows hashed by `keys`, so following windows on the same keys add no
    shuffle. Rows outside start..end are dropped. A row that is not on the calendar of the lower bound, or a (key, step)
    that occurs twice, raises an error that names key and step.
    """
    known = bounds(df, time) if start is None or end is None else None
    if known is not None:
        df = df.withColumn("__b", known)
    number = unit == "number"
    lo = q("__b")["lo"] if start is None else (F.lit(start) if number and not isinstance(start, Column) else _edge(start, None))
    hi = q("__b")["hi"] if end is None else (F.lit(end) if number and not isinstance(end, Column) else _edge(end, None))
    df = df.withColumns({"__lo": lo, "__hi": hi}).where((q(time) >= q("__lo")) & (q(time) <= q("__hi")))
    w = W.partitionBy(*qs(keys)).orderBy(q(time))
    first = F.lag(q(time)).over(w).isNull()
    follower = F.lead(q(time)).over(w)
    df = df.withColumns({"__first": first, "__follower": follower})
    named = F.concat_ws(", ", *[F.coalesce(q(c).cast("string"), F.lit("null")) for c in [*keys, time]])
    off = F.raise_error(F.concat(F.lit("not on the calendar: "), named))
    twice = F.raise_error(F.concat(F.lit("occurs twice: "), named))
    begin = F.when(q("__first"), q("__lo")).otherwise(q(time))
    begin = F.when(~_on_grid(q("__lo"), q(time), unit), off).when(q("__follower") == q(time), twice).otherwise(begin)
    stop = F.coalesce(_next(q("__follower"), unit, -1), q("__hi"))
    values = [c for c in df.columns if c not in keys and c != time and not c.startswith("__")]
    df = df.withColumn("__t", F.explode(_steps(begin, stop, unit)))
    own = q("__t") == q(time)
    keep = {c: F.when(own, q(c)) for c in values}
    names = [c for c in df.columns if not c.startswith("__")]
    return df.select(*[q("__t").alias(c) if c == time else keep[c].alias(c) if c in keep else q(c) for c in names])


def upsample(
    df: DataFrame, *, keys: Sequence[str], time: str, cols: Sequence[str], fill: str = "linear", unit: str = "month"
) -> DataFrame:
    """Annual (or sparser) panel to a finer step.

    linear: steps from the first to the last date of the whole frame, interpolated per series by number of steps, so
    a series that ends early is carried to the common end. repeat: the value of a year stands for each of its months.
    """
    panel = df.select(*qs([*keys, time, *cols]))
    if fill == "linear":
        return interpolate(densify(panel, time=time, keys=keys, unit=unit), keys=keys, order=time, cols=cols)
    if fill == "repeat":
        first = F.trunc(q(time), "year")
        months = F.explode(_steps(first, F.add_months(first, 11), "month"))
        return panel.withColumn("__m", months).drop(time).withColumnRenamed("__m", time).select(*qs(panel.columns))
    raise ValueError(f"unknown fill {fill!r}")


def split_quarters(
    df: DataFrame, *, keys: Sequence[str], time: str, cols: Sequence[str], null_as_zero: bool = True
) -> DataFrame:
    """Spread the value in the first month of a quarter evenly over its three months.

    A quarter whose first month is absent or unknown keeps its own values. With `null_as_zero` missing values become
    0 first, so a missing quarter start yields zeros. Window partitions are (key, quarter): three rows each.
    """
    if null_as_zero:
        df = df.withColumns({c: F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in cols})
    df = df.withColumn("__q", F.trunc(q(time), "quarter"))
    w = W.partitionBy(*qs(keys), q("__q"))
    at_start = q(time) == q("__q")
    shares = {c: F.coalesce(F.max(F.when(at_start, q(c))).over(w) / 3, q(c).cast("double")) for c in cols}
    return df.withColumns(shares).drop("__q")


def calendar(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns(
        {"Year": F.year(q(col)), "Month": F.month(q(col)), "Quarter": F.quarter(q(col)), "Day": F.dayofmonth(q(col))}
    )


def carry_last(
    df: DataFrame, *, keys: Sequence[str], order: str, cols: Sequence[str], time: str, unit: str, start: Any, end: Any
) -> DataFrame:
    """Future calendar per key with the last observed row's values on every step."""
    last = df.groupBy(*qs(keys)).agg(F.max_by(F.struct(*qs(cols)), q(order)).alias("__last"))
    flat = last.select(*qs(keys), *[q("__last").getField(c).alias(c) for c in cols])
    return future_calendar(flat, time=time, unit=unit, start=start, end=end)


def attach_year_values(df: DataFrame, yearly: DataFrame, *, keys: Sequence[str], time: str, year: str) -> DataFrame:
    """Add a yearly panel's columns to every finer row of the same key and year."""
    tagged = df.withColumn(year, F.year(q(time)))
    return join_back(tagged, yearly, [*keys, year]).drop(year)
