"""Filling missing values from group, frame or history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators.common import join_back, q, qs, with_stats
from growthlens.operators.series import interpolate
from growthlens.operators.stats import quantiles, ranked


def fill_means(df: DataFrame, *, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Fill with the group mean, then with the mean of the column as it stands after that step.

    The second mean follows from the per-group sums and counts, so the rows are aggregated once.
    """
    parts = []
    for i, c in enumerate(cols):
        v = q(c).cast("double")
        parts += [F.sum(v).alias(f"__s{i}"), F.count(v).alias(f"__c{i}")]
    groups = df.groupBy(*qs(keys)).agg(F.count("*").alias("__rows"), *parts)
    overall = []
    for i in range(len(cols)):
        some = q(f"__c{i}") > 0
        mean = F.try_divide(q(f"__s{i}"), q(f"__c{i}"))
        filled_sum = F.sum(F.when(some, q(f"__s{i}") + (q("__rows") - q(f"__c{i}")) * mean))
        overall.append(F.try_divide(filled_sum, F.sum(F.when(some, q("__rows")))).alias(f"o{i}"))
    frame_mean = groups.agg(F.struct(*overall).alias("o")).scalar()
    means = groups.select(*qs(keys), *[F.try_divide(q(f"__s{i}"), q(f"__c{i}")).alias(f"__m{i}") for i in range(len(cols))])
    rows = join_back(df, means, keys).withColumn("__o", frame_mean)
    filled = {c: F.coalesce(q(c).cast("double"), q(f"__m{i}"), q("__o")[f"o{i}"]) for i, c in enumerate(cols)}
    return rows.withColumns(filled).select(*qs(df.columns))


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill with the exact median of the whole column; all columns share the two scans the medians take."""
    medians = ranked(df, [], cols, [0.5])
    wide = F.struct(*[F.max(F.when(q("__column") == i, q("p0"))).alias(f"c{i}") for i in range(len(cols))])
    rows = df.withColumn("__med", medians.agg(wide).scalar())
    filled = {c: F.coalesce(q(c).cast("double"), q("__med")[f"c{i}"]) for i, c in enumerate(cols)}
    return rows.withColumns(filled).drop("__med")


def fill_constant(df: DataFrame, cols: Sequence[str], value: float = 0) -> DataFrame:
    return df.fillna(value, subset=list(cols))


def repair(
    df: DataFrame, history: DataFrame, *, keys: Sequence[str], order: str, col: str, floor_prob: float = 0.05
) -> DataFrame:
    """Make a forecast positive: values <= 0 are interpolated both ways inside their series; a series without any
    positive value takes a low quantile of its history, or 0."""
    df = df.withColumn(col, F.when(q(col) > 0, q(col)))
    df = interpolate(df, keys=keys, order=order, cols=[col], direction="both")
    floor = quantiles(history, keys=keys, col=col, probs=[floor_prob], names=["__floor"]).select(*qs(keys), "__floor")
    out = join_back(df, floor, keys)
    return out.withColumn(col, F.coalesce(q(col), q("__floor"), F.lit(0.0))).drop("__floor")


def fill_group_stat(df: DataFrame, *, keys: Sequence[str], cols: Sequence[str], fn: str = "avg") -> DataFrame:
    """Fill with one aggregate of the group only."""
    stats = {f"__g{i}": getattr(F, fn)(q(c)) for i, c in enumerate(cols)}
    rows = with_stats(df, keys, stats)
    return rows.withColumns({c: F.coalesce(q(c), q(f"__g{i}")) for i, c in enumerate(cols)}).select(*qs(df.columns))
