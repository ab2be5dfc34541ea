"""Linear trend per series in closed form: one aggregate, no rows gathered."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.operators.calendars import future_calendar
from growthlens.operators.common import join_back, q, qs

_ORIGIN = "2000-01-01"


def days(time: str) -> Column:
    return F.date_diff(q(time), F.lit(_ORIGIN).cast("date")).cast("double")


def trend_lines(df: DataFrame, *, keys: Sequence[str], time: str, target: str) -> DataFrame:
    x, y = days(time), q(target).cast("double")
    return df.groupBy(*qs(keys)).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def fit_trend(df: DataFrame, *, keys: Sequence[str], time: str, target: str, part: str = "part") -> DataFrame:
    """Fit on `train` rows, predict the `test` rows: keys, time, target, predicted."""
    lines = trend_lines(df.where(q(part) == "train"), keys=keys, time=time, target=target)
    test = join_back(df.where(q(part) == "test").select(*qs([*keys, time, target])), lines, keys)
    return test.withColumn("predicted", q("intercept") + q("slope") * days(time)).drop("slope", "intercept")


def forecast_trend(
    df: DataFrame, *, keys: Sequence[str], time: str, target: str, start: Any, end: Any, unit: str = "month"
) -> DataFrame:
    """Fit on all rows and extend to the calendar from start to end; steps are generated from the fitted lines."""
    lines = trend_lines(df, keys=keys, time=time, target=target)
    future = future_calendar(lines, time=time, unit=unit, start=start, end=end)
    return future.select(*qs([*keys, time]), (q("intercept") + q("slope") * days(time)).alias("predicted"))
