"""Per-series forecasts, backtests and model choice."""

from growthlens.forecasting.additive import fit_additive, forecast_additive
from growthlens.forecasting.backtest import backtest_and_forecast
from growthlens.forecasting.clusters import cluster_profiles
from growthlens.forecasting.growth import growth_metrics, what_if
from growthlens.forecasting.scoring import pick_best, score
from growthlens.forecasting.trees import fit_trees, forecast_trees
from growthlens.forecasting.trend import fit_trend, forecast_trend

__all__ = [
    "backtest_and_forecast",
    "cluster_profiles",
    "fit_additive",
    "fit_trees",
    "fit_trend",
    "forecast_additive",
    "forecast_trees",
    "forecast_trend",
    "growth_metrics",
    "pick_best",
    "score",
    "what_if",
]
