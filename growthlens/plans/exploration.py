"""Exploration tables of the housing features, and the single-target model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.forecasting.additive import fit_additive
from growthlens.forecasting.clusters import cluster_profiles
from growthlens.forecasting.scoring import score
from growthlens.forecasting.trees import fit_trees
from growthlens.operators.aggregates import supply_demand
from growthlens.operators.common import q, qs
from growthlens.operators.project import complete_rows, drop_value, keep_values
from growthlens.operators.series import lags
from growthlens.operators.splits import split_train_test
from growthlens.operators.stats import correlation, distribution, profile, zscore
from growthlens.plans.housing import FEATURES, PRICE_INDEX, STARTS


def housing_exploration(features: DataFrame) -> dict[str, DataFrame]:
    """Summary, outliers, clusters, correlations, distributions, supply against demand; provinces only where the
    national row would dominate."""
    rows = complete_rows(features, list(PRICE_INDEX.values()))
    provinces = drop_value(rows, "GEO", "Canada")
    yearly = rows.withColumn("Year", F.year("REF_DATE"))
    flagged = zscore(rows.select("REF_DATE", "GEO", *qs(STARTS)), STARTS)
    any_outlier = q(f"{STARTS[0]}_outlier")
    for c in STARTS[1:]:
        any_outlier = any_outlier | q(f"{c}_outlier")
    return {
        "summary": profile(rows, FEATURES),
        "outliers": flagged.where(any_outlier),
        "clusters": cluster_profiles(provinces, key="GEO", cols=STARTS),
        "correlations": correlation(provinces, FEATURES),
        "distributions": distribution(provinces, keys=["GEO"], col="Housing starts", bounded=True),
        "supply_demand": supply_demand(
            yearly, ["Year", "GEO"], demand="Number_of_Households", supply="Housing completions"
        ),
    }


def compare_models(
    features: DataFrame, *, target: str = "Number_of_Households", region: str = "Canada", last_n: int = 30,
    n_lags: int = 3, kinds: Sequence[str] = ("rf", "gbt"), trees: int = 100,
) -> DataFrame:
    """Mean absolute error of each model on the last months of one region: model, mae."""
    rows = keep_values(features, "GEO", [region]).select("GEO", "REF_DATE", q(target).cast("double").alias("y"))
    keys, order = ["GEO"], "REF_DATE"
    additive = fit_additive(
        split_train_test(rows, keys=keys, order=order, last_n=last_n), keys=keys, time=order, target="y",
        seasonalities=[("yearly", 365.25, 10)],
    ).withColumn("model", F.lit("additive"))
    lagged = lags(rows, keys=keys, order=order, cols=["y"], ks=list(range(1, n_lags + 1)))
    lagged = complete_rows(lagged.withColumn("month", F.month(order)))
    split = split_train_test(lagged, keys=keys, order=order, last_n=last_n)
    names = [*[f"y_lag_{k}" for k in range(1, n_lags + 1)], "month"]
    out = additive
    for kind in kinds:
        fitted = fit_trees(split, keys=keys, time=order, target="y", features=names, kind=kind, trees=trees)
        out = out.unionByName(fitted.withColumn("model", F.lit(kind)))
    return score(out, keys=["model"], actual="y", predicted="predicted").select("model", "mae")
