"""Additive model per series: piecewise-linear trend, Fourier seasonality, extra regressors.

After Taylor & Letham, "Forecasting at Scale" (2018), fitted here as a penalised least-squares problem. Spark shuffles
each series to one Python task; a panel series is as long as its calendar, so that group has a fixed bound, and
all series of all regions and columns run in one grouped job.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.operators.calendars import carry_last, future_calendar
from growthlens.operators.common import q, qs

# The grouped function travels by value, so workers need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
# (name, period in days, Fourier order) of the two seasonal terms of the education forecast.
EDUCATION_SEASONS = (("monthly", 30.5, 5), ("yearly", 365.25, 10))


def fit_additive(
    df: DataFrame,
    *,
    keys: Sequence[str],
    time: str,
    target: str,
    regressors: Sequence[str] = (),
    seasonalities: Sequence[tuple[str, float, int]] = (),
    changepoint_scale: float = 0.05,
    part: str = "part",
) -> DataFrame:
    """Fit on `train` rows, predict the `test` rows: keys, time, target, predicted.

    Regressors of the test rows take their last training value, since the future of a regressor is not known.
    Missing targets are left out of the fit; a series without two known targets gives no rows.
    """
    keys, regressors = list(keys), list(regressors)
    day = F.date_diff(q(time), F.lit("1970-01-01").cast("date")).cast("double")
    rows = df.select(
        *qs([*keys, time]),
        q(target).cast("double").alias("__y"),
        day.alias("__day"),
        (q(part) == "train").alias("__train"),
        *[q(r).cast("double").alias(f"__x{i}") for i, r in enumerate(regressors)],
    )
    fields = [df.schema[k] for k in keys] + [df.schema[time]]
    schema = T.StructType(fields + [T.StructField(target, T.DoubleType()), T.StructField("predicted", T.DoubleType())])
    seasons = tuple(seasonalities)
    x_cols = [f"__x{i}" for i in range(len(regressors))]

    def one_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__day")
        train = pdf[pdf["__train"] & pdf["__y"].notna()]
        test = pdf[~pdf["__train"]]
        if len(train) < 2 or test.empty:
            return pdf.iloc[:0][[*keys, time]].assign(**{target: 0.0, "predicted": 0.0})
        held = pdf.loc[pdf["__train"], x_cols].ffill().iloc[-1].to_numpy(float)
        fitted = _fit(
            train["__day"].to_numpy(), train["__y"].to_numpy(float), train[x_cols].to_numpy(float),
            test["__day"].to_numpy(), np.tile(held, (len(test), 1)), seasons, changepoint_scale,
        )
        out = test[[*keys, time]].copy()
        out[target] = test["__y"]
        out["predicted"] = fitted
        return out

    return rows.groupBy(*qs(keys)).applyInPandas(one_series, schema)


def forecast_additive(
    df: DataFrame,
    *,
    keys: Sequence[str],
    time: str,
    target: str,
    regressors: Sequence[str] = (),
    seasonalities: Sequence[tuple[str, float, int]] = (),
    changepoint_scale: float = 0.05,
    start: Any,
    end: Any,
    unit: str = "month",
) -> DataFrame:
    """Fit on all rows and predict the calendar from start to end: keys, time, predicted."""
    regressors = list(regressors)
    past = df.select(*qs([*keys, time, target, *regressors])).withColumn("part", F.lit("train"))
    if regressors:
        ahead = carry_last(
            past, keys=keys, order=time, cols=regressors, time=time, unit=unit, start=start, end=end
        )
    else:
        ahead = future_calendar(past.select(*qs(keys)).distinct(), time=time, unit=unit, start=start, end=end)
    ahead = ahead.withColumns({target: F.lit(None).cast("double"), "part": F.lit("test")})
    both = past.unionByName(ahead.select(*qs(past.columns)))
    out = fit_additive(
        both, keys=keys, time=time, target=target, regressors=regressors, seasonalities=seasonalities,
        changepoint_scale=changepoint_scale,
    )
    return out.drop(target)


def _fit(day, y, x, day_ahead, x_ahead, seasons, changepoint_scale):
    first, span = day[0], max(day[-1] - day[0], 1.0)
    scale = np.abs(y).max() or 1.0
    history = (day - first) / span
    places = np.unique(np.linspace(0, int((len(day) - 1) * CHANGEPOINT_RANGE), CHANGEPOINTS + 1).round().astype(int))[1:]
    bends = history[places]
    x = np.where(np.isnan(x), np.nanmean(x, axis=0) if x.size else 0.0, x) if np.isnan(x).any() else x
    mean, std = (x.mean(axis=0), x.std(axis=0)) if x.size else (np.zeros(0), np.zeros(0))
    std = np.where(std > 0, std, 1.0)

    def design(days, regs):
        t = (days - first) / span
        waves = []
        for _, period, order in seasons:
            angle = 2 * np.pi * np.outer(days / period, np.arange(1, order + 1))
            waves += [np.sin(angle), np.cos(angle)]
        regs = np.where(np.isnan(regs), mean, regs)
        return np.hstack([np.ones((len(t), 1)), t[:, None], np.maximum(t[:, None] - bends, 0.0), *waves, (regs - mean) / std])

    # Prior widths of intercept, slope, bends, seasonal and regressor weights; the noise level is re-estimated.
    n_waves = 2 * sum(order for _, _, order in seasons)
    width = np.concatenate([[5.0, 5.0], np.full(len(bends), changepoint_scale), np.full(n_waves + x.shape[1], 10.0)])
    a, b, noise = design(day, x), y / scale, 0.05
    for _ in range(5):
        weights = np.linalg.solve(a.T @ a + np.diag((noise / width) ** 2 + 1e-9), a.T @ b)
        noise = max(float(np.sqrt(np.mean((b - a @ weights) ** 2))), 1e-4)
    return design(day_ahead, x_ahead) @ weights * scale
