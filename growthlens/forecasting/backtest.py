"""Backtest candidates, pick the best per series, refit on all data, forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.forecasting.additive import fit_additive, forecast_additive
from growthlens.forecasting.scoring import pick_best, score
from growthlens.forecasting.trees import fit_trees, forecast_trees
from growthlens.forecasting.trend import fit_trend, forecast_trend
from growthlens.operators.common import q, qs
from growthlens.operators.splits import split_train_test
from growthlens.session import ensure_checkpoint_dir


class NotEnoughData(ValueError):
    """No series is long enough to be split."""


def backtest_and_forecast(
    df: DataFrame,
    *,
    keys: Sequence[str],
    time: str,
    target: str,
    features: Sequence[str],
    start: Any,
    end: Any,
    candidates: Sequence[str] = ("additive", "rf", "gbt"),
    unit: str = "month",
    frac: float | None = 0.8,
    last_n: int | None = None,
    min_rows: int = 50,
    trees: int = 100,
    tree_options: Mapping[str, Any] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(metrics, forecast): metrics per key and model, and the forecast of each key's best model.

    `tree_options` go to the tree models (depth, seed, rate, key_feature). Trees are fitted per series, and a model is
    refitted on the series it has won and no others; with `per_group=False` in `tree_options` one pooled model learns
    from all series, also in the refit. The feature panel is written once to the checkpoint folder: every candidate
    reads it.
    """
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    panel = df.select(*qs(list(dict.fromkeys([*keys, time, target, *features]))))
    split = split_train_test(
        panel, keys=keys, order=time, frac=frac, last_n=last_n, min_rows=min_rows
    ).checkpoint()
    if split.isEmpty():
        raise NotEnoughData(f"no series has {min_rows} rows")
    grown = {"trees": trees, "per_group": True, **(tree_options or {})}
    common = {"keys": keys, "time": time, "target": target}

    def test_rows(name: str) -> DataFrame:
        if name == "trend":
            out = fit_trend(split, **common)
        elif name == "additive":
            out = fit_additive(split, regressors=features, **common)
        else:
            out = fit_trees(split, features=features, kind=name, **grown, **common)
        return out.withColumn("model", F.lit(name))

    predictions = reduce(DataFrame.unionByName, [test_rows(c) for c in candidates])
    metrics = score(predictions, keys=[*keys, "model"], actual=target, predicted="predicted").checkpoint()
    best = pick_best(metrics, keys=keys, prefer=candidates)
    horizon = {"start": start, "end": end, "unit": unit}
    history = split.drop("part")

    def ahead(name: str) -> DataFrame:
        chosen = best.where(q("best_model") == name)
        winners = history.join(chosen, on=keys, how="left_semi")
        if name == "trend":
            out = forecast_trend(winners, **common, **horizon)
        elif name == "additive":
            out = forecast_additive(winners, regressors=features, **common, **horizon)
        elif grown["per_group"]:
            out = forecast_trees(winners, features=features, kind=name, **grown, **common, **horizon)
        else:
            # The pooled model learns from every series, its forecast is kept for the winners.
            out = forecast_trees(history, features=features, kind=name, **grown, **common, **horizon)
            out = out.join(chosen, on=keys, how="left_semi")
        return out.withColumn("model", F.lit(name))

    used = {r["best_model"] for r in best.select("best_model").distinct().collect()}  # at most one row per candidate
    if not used:
        raise NotEnoughData("no candidate could be scored")
    return metrics, reduce(DataFrame.unionByName, [ahead(c) for c in candidates if c in used])
