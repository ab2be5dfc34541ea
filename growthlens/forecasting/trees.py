"""Tree regressions on lag, rolling and calendar features: pooled with Spark ML, or one model per series."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.forecasting.series_trees import fit_series_trees
from growthlens.operators.calendars import carry_last
from growthlens.operators.common import join_back, q, qs
from growthlens.operators.project import complete_rows


def fit_trees(
    df: DataFrame,
    *,
    keys: Sequence[str],
    time: str,
    target: str,
    features: Sequence[str],
    kind: str = "rf",
    seed: int = 42,
    trees: int = 100,
    depth: int = 8,
    key_feature: bool = True,
    per_group: bool = False,
    rate: float = 0.3,
    part: str = "part",
) -> DataFrame:
    """Fit on `train` rows, predict the `test` rows: keys, time, target, predicted.

    One pooled model over all series, trained on the cluster (an action). With `key_feature` a series is known to it by
    the mean, deviation and slope of its training target, whatever the number of series. With `per_group` every series
    has a model of its own, all of them grown in one job and nothing run before it is asked for; a series without
    training rows gets no prediction. `rate` shrinks the boosted trees.
    Rows with a missing feature or target take no part in the fit, rows with a missing feature get no prediction.
    """
    if kind not in ("rf", "gbt"):
        raise ValueError(f"unknown tree model {kind!r}")
    rows = df.select(*qs([*keys, time, part]), q(target).cast("double").alias("__y"), *_features(features))
    names = [f"__f{i}" for i in range(len(features))]
    rows = complete_rows(rows, names)
    train = (q(part) == "train") & q("__y").isNotNull()
    if per_group:
        rows = rows.where(train | (q(part) == "test"))
        how = {"kind": kind, "trees": trees, "depth": depth, "rate": rate, "seed": seed}
        found = fit_series_trees(rows, keys=keys, time=time, target="__y", features=names, train=train, **how)
        return found.where(q("predicted").isNotNull()).withColumnRenamed("__y", target)
    if key_feature:
        rows, extra = _described(rows, keys, time, train)
        names = [*names, *extra]
    stages = [VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="keep")]
    common = {
        "featuresCol": "__features", "labelCol": "__y", "predictionCol": "predicted", "seed": seed, "maxDepth": depth
    }
    if kind == "rf":
        stages.append(RandomForestRegressor(numTrees=trees, **common))
    else:
        stages.append(GBTRegressor(maxIter=trees, stepSize=rate, **common))
    model = Pipeline(stages=stages).fit(rows.where(train))
    predicted = model.transform(rows.where(q(part) == "test"))
    return predicted.select(*qs([*keys, time]), q("__y").alias(target), "predicted")


def forecast_trees(
    df: DataFrame,
    *,
    keys: Sequence[str],
    time: str,
    target: str,
    features: Sequence[str],
    start: Any,
    end: Any,
    unit: str = "month",
    **options,
) -> DataFrame:
    """Fit on all rows; predict the calendar from start to end with each series' last observed features."""
    past = df.select(*qs([*keys, time, target, *features])).withColumn("part", F.lit("train"))
    ahead = carry_last(past, keys=keys, order=time, cols=list(features), time=time, unit=unit, start=start, end=end)
    ahead = ahead.withColumns({target: F.lit(None).cast("double"), "part": F.lit("test")})
    both = past.withColumn(target, q(target).cast("double")).unionByName(ahead.select(*qs(past.columns)))
    out = fit_trees(both, keys=keys, time=time, target=target, features=features, **options)
    return out.drop(target)


def _described(rows, keys, time, train):
    """Rows with the mean, deviation and slope of each series' training target; 0 where a series has none."""
    kind = dict(rows.dtypes)[time]
    step = F.unix_date(time) if kind == "date" else q(time).cast("timestamp").cast("double") if "timestamp" in kind else q(time)
    y = F.when(train, q("__y"))
    stats = {"__mean": F.avg(y), "__deviation": F.stddev_pop(y), "__slope": F.regr_slope(y, step.cast("double"))}
    series = rows.groupBy(*qs(keys)).agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in stats.items()])
    return join_back(rows, series, keys), list(stats)


def _features(features):
    return [q(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)]
