"""Clusters of region profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators.common import q, qs, with_stats
from growthlens.session import ensure_checkpoint_dir


def region_profiles(df: DataFrame, *, key: str, cols: Sequence[str]) -> DataFrame:
    """Mean per region, standardised with the population deviation over regions."""
    means = df.groupBy(q(key)).agg(*[F.avg(q(c)).alias(c) for c in cols])
    stats = {}
    for i, c in enumerate(cols):
        stats |= {f"__m{i}": F.avg(q(c)), f"__d{i}": F.stddev_pop(q(c))}
    rows = with_stats(means, (), stats)
    scaled = {f"{c}_scaled": F.coalesce(F.try_divide(q(c) - q(f"__m{i}"), q(f"__d{i}")), F.lit(0.0)) for i, c in enumerate(cols)}
    return rows.withColumns(scaled).drop(*stats)


def cluster_profiles(
    df: DataFrame, *, key: str, cols: Sequence[str], k: int = 3, seed: int = 42, restarts: int = 10
) -> DataFrame:
    """k-means on standardised region profiles; the cheapest of several seeded runs wins (an action per run)."""
    ensure_checkpoint_dir(df.sparkSession)
    profiles = region_profiles(df, key=key, cols=cols)
    assembler = VectorAssembler(inputCols=[f"{c}_scaled" for c in cols], outputCol="__features", handleInvalid="skip")
    points = assembler.transform(profiles).checkpoint()
    runs = [KMeans(k=k, seed=seed + i, featuresCol="__features", predictionCol="cluster").fit(points) for i in range(restarts)]
    best = min(runs, key=lambda m: m.summary.trainingCost)
    return best.transform(points).select(*qs([key, *cols, "cluster"]))
