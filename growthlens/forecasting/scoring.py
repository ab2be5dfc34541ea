"""Forecast errors and the choice of a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators.common import q, qs

# Ties go to the model named first.
PREFERENCE = ("additive", "rf", "gbt")


def score(df: DataFrame, *, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE and R2 per key over rows where both values are known; one aggregate with map-side combine."""
    a, e = q(actual).cast("double"), q(actual).cast("double") - q(predicted)
    rows = df.where(q(actual).isNotNull() & q(predicted).isNotNull())
    return rows.groupBy(*qs(keys)).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count("*"))).alias("r2"),
    )


def pick_best(
    metrics: DataFrame, *, keys: Sequence[str], by: str = "rmse", model: str = "model", prefer: Sequence[str] = PREFERENCE
) -> DataFrame:
    """Model with the smallest error per key; infinite and missing errors are no candidates."""
    finite = q(by).isNotNull() & ~F.isnan(q(by)) & (q(by) < float("inf"))
    place = F.array_position(F.array(*[F.lit(p) for p in prefer]), q(model))
    rank = F.struct(q(by), F.when(place > 0, place).otherwise(len(prefer) + 1), q(model))
    return metrics.where(finite).groupBy(*qs(keys)).agg(F.min_by(q(model), rank).alias("best_model"))
