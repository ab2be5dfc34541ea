"""Growth metrics, scenarios, trends, backtests, model choice, forecasts, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlens.forecasting import (
    backtest_and_forecast,
    cluster_profiles,
    fit_additive,
    fit_trend,
    fit_trees,
    forecast_additive,
    forecast_trend,
    growth_metrics,
    pick_best,
    score,
    what_if,
)
from growthlens.forecasting.additive import EDUCATION_SEASONS
from growthlens.forecasting.clusters import region_profiles
from growthlens.operators.calendars import calendar
from growthlens.operators.project import complete_rows
from growthlens.operators.series import lags, rolling_mean
from growthlens.operators.splits import split_train_test
from growthlens.queries.inputs import MONTHLY, NATION_ORDERS, monthly, nation_orders, round_cols
from growthlens.queries.registry import query

FLOWS = {"prs": "prs", "trs": "trs", "births": "births", "deaths": "deaths", "estimate": "estimate"}
NAMES = {
    "Net Migration": "net_migration",
    "Natural Increase": "natural_increase",
    "Net Population Change": "net_change",
    "Net Migration Rate": "migration_rate",
    "Natural Growth Rate": "natural_rate",
    "Population Growth Rate (%)": "growth_pct",
    "Net Migration %": "migration_share",
    "Natural Increase %": "natural_share",
    "Net Population Change %": "change_share",
}


def _flows(spark, sf_dir):
    """(nation, month): order counts by status and priority in the roles of in- and outflows."""
    c = F.col
    return nation_orders(spark, sf_dir).groupBy("nation", "month").agg(
        F.count_if(c("o_orderstatus") == "F").alias("prs"),
        F.count_if(c("o_orderstatus") == "O").alias("trs"),
        F.count_if(c("o_orderpriority") == "1-URGENT").alias("births"),
        F.count_if(c("o_orderpriority") == "5-LOW").alias("deaths"),
        F.count_if(c("o_orderpriority") != "3-MEDIUM").alias("estimate"),
    )


_FLOWS = f"""{NATION_ORDERS},
flows AS (
  SELECT nation, month, CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS prs,
         CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS trs,
         CAST(COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS births,
         CAST(COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS DOUBLE) AS deaths,
         CAST(COUNT(*) FILTER (WHERE o_orderpriority <> '3-MEDIUM') AS DOUBLE) AS estimate
  FROM nation_orders GROUP BY ALL)"""


def _named(df):
    out = df.withColumnsRenamed({k: v for k, v in NAMES.items() if k in df.columns})
    return round_cols(out, [c for c in out.columns if c.endswith(("_rate", "_pct", "_share"))], 6)


@query(f"""
WITH {_FLOWS}, c AS (SELECT *, prs - trs AS mig, births - deaths AS nat FROM flows)
SELECT nation, month, prs, trs, births, deaths, estimate, mig AS net_migration, nat AS natural_increase, mig + nat AS net_change,
       ROUND(CASE WHEN estimate <> 0 THEN mig * 1000 / estimate ELSE 0 END, 6) AS migration_rate,
       ROUND(CASE WHEN estimate <> 0 THEN nat * 1000 / estimate ELSE 0 END, 6) AS natural_rate,
       ROUND(CASE WHEN estimate <> 0 THEN (mig + nat) * 100 / estimate ELSE 0 END, 6) AS growth_pct
FROM c""")
def population_metrics(spark, sf_dir):
    return _named(growth_metrics(_flows(spark, sf_dir), "pipeline", inputs=FLOWS))


@query(f"""
WITH {_FLOWS},
c AS (SELECT *, CASE WHEN prs <> 0 AND trs <> 0 THEN prs - trs ELSE 0 END AS mig,
             CASE WHEN births <> 0 AND deaths <> 0 THEN births - deaths ELSE 0 END AS nat FROM flows),
d AS (SELECT *, CASE WHEN estimate <> 0 THEN mig + nat ELSE 0 END AS chg FROM c)
SELECT nation, month, prs, trs, births, deaths, estimate, mig AS net_migration, nat AS natural_increase, chg AS net_change,
       ROUND(CASE WHEN estimate <> 0 THEN mig / estimate * 1000 ELSE 0 END, 6) AS migration_rate,
       ROUND(CASE WHEN estimate <> 0 THEN nat / estimate * 1000 ELSE 0 END, 6) AS natural_rate,
       ROUND(CASE WHEN estimate <> 0 THEN chg / estimate * 100 ELSE 0 END, 6) AS growth_pct
FROM d""")
def population_metrics_notebook(spark, sf_dir):
    return _named(growth_metrics(_flows(spark, sf_dir), "notebook", inputs=FLOWS))


@query(f"""
WITH {_FLOWS},
c AS (SELECT *, CASE WHEN prs <> 0 AND trs <> 0 THEN prs + trs ELSE 0 END AS mig,
             CASE WHEN births <> 0 AND deaths <> 0 THEN births - deaths ELSE 0 END AS nat FROM flows),
d AS (SELECT *, CASE WHEN mig <> 0 AND nat <> 0 THEN mig + nat ELSE 0 END AS chg FROM c)
SELECT nation, month, prs, trs, births, deaths, estimate, mig AS net_migration, nat AS natural_increase, chg AS net_change,
       ROUND(COALESCE(mig * 100 / nullif(estimate, 0), 0), 6) AS migration_rate,
       ROUND(COALESCE(nat * 100 / nullif(estimate, 0), 0), 6) AS natural_rate,
       ROUND(COALESCE(chg * 100 / nullif(estimate, 0), 0), 6) AS growth_pct,
       ROUND(COALESCE(mig * 100 / nullif(mig + nat, 0), 0), 6) AS migration_share,
       ROUND(COALESCE(nat * 100 / nullif(mig + nat, 0), 0), 6) AS natural_share,
       ROUND(COALESCE(chg * 100 / nullif(mig + nat, 0), 0), 6) AS change_share
FROM d""")
def population_metrics_documented(spark, sf_dir):
    return _named(growth_metrics(_flows(spark, sf_dir), "documented", inputs=FLOWS))


SCENARIOS = [("as is", 1.0, 1.0), ("half of temporary", 1.0, 0.5), ("double permanent", 2.0, 1.0)]


@query(f"""
WITH {_FLOWS}, s(scenario, p, t) AS (VALUES ('as is', 1.0, 1.0), ('half of temporary', 1.0, 0.5), ('double permanent', 2.0, 1.0)),
f AS (SELECT scenario, nation, month, CAST(prs * p AS DOUBLE) AS prs, CAST(trs * t AS DOUBLE) AS trs, births, deaths, estimate FROM flows, s),
c AS (SELECT *, prs - trs AS mig, births - deaths AS nat FROM f)
SELECT scenario, nation, month, prs, trs, births, deaths, estimate, mig AS net_migration, nat AS natural_increase, mig + nat AS net_change,
       ROUND(CASE WHEN estimate <> 0 THEN mig * 1000 / estimate ELSE 0 END, 6) AS migration_rate,
       ROUND(CASE WHEN estimate <> 0 THEN nat * 1000 / estimate ELSE 0 END, 6) AS natural_rate,
       ROUND(CASE WHEN estimate <> 0 THEN (mig + nat) * 100 / estimate ELSE 0 END, 6) AS growth_pct
FROM c""")
def scenario_what_if(spark, sf_dir):
    return _named(what_if(_flows(spark, sf_dir), SCENARIOS, inputs=FLOWS))


@query(f"""
WITH {MONTHLY},
x AS (SELECT nation, date_diff('day', DATE '2000-01-01', month) AS d, n_orders FROM monthly),
fit AS (SELECT nation, regr_slope(n_orders, d) AS b, regr_intercept(n_orders, d) AS a FROM x GROUP BY 1)
SELECT nation, CAST(m AS DATE) AS month, ROUND(a + b * date_diff('day', DATE '2000-01-01', CAST(m AS DATE)), 6) AS predicted
FROM fit, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2035-12-01', INTERVAL 1 MONTH)) AS m)""")
def trend_forecast(spark, sf_dir):
    out = forecast_trend(
        monthly(spark, sf_dir), keys=["nation"], time="month", target="n_orders", start="2024-01-01", end="2035-12-01"
    )
    return round_cols(out, ["predicted"], 6)


def _split(spark, sf_dir):
    return split_train_test(monthly(spark, sf_dir), keys=["nation"], order="month", min_rows=50)


def _naive(split):
    """Predict every test month with the last training value."""
    last = split.where("part = 'train'").groupBy("nation").agg(F.max_by("n_orders", "month").alias("predicted"))
    test = split.where("part = 'test'").select("nation", "month", F.col("n_orders").cast("double").alias("n_orders"))
    return test.join(last.withColumn("predicted", F.col("predicted").cast("double")), "nation")


_BACKTEST = f"""{MONTHLY},
placed AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY month) AS rn, COUNT(*) OVER (PARTITION BY nation) AS n,
                  date_diff('day', DATE '2000-01-01', month) AS d FROM monthly),
split AS (SELECT *, rn <= floor(0.8 * n) AS train FROM placed WHERE n >= 50),
fit AS (SELECT nation, regr_slope(n_orders, d) AS b, regr_intercept(n_orders, d) AS a, arg_max(n_orders, month) AS last
        FROM split WHERE train GROUP BY 1),
predictions AS (
  SELECT nation, 'trend' AS model, n_orders AS y, a + b * d AS p FROM split JOIN fit USING (nation) WHERE NOT train
  UNION ALL SELECT nation, 'naive', n_orders, last FROM split JOIN fit USING (nation) WHERE NOT train),
metrics AS (
  SELECT nation, model, sqrt(AVG((y - p) * (y - p))) AS rmse, AVG(abs(y - p)) AS mae,
         1 - SUM((y - p) * (y - p)) / (var_pop(y) * COUNT(*)) AS r2 FROM predictions GROUP BY 1, 2)"""


def _metrics(spark, sf_dir):
    split = _split(spark, sf_dir)
    trend = fit_trend(split, keys=["nation"], time="month", target="n_orders").withColumn("model", F.lit("trend"))
    both = trend.unionByName(_naive(split).withColumn("model", F.lit("naive")))
    return score(both, keys=["nation", "model"], actual="n_orders", predicted="predicted")


@query(f"WITH {_BACKTEST} SELECT nation, model, ROUND(rmse, 6) AS rmse, ROUND(mae, 6) AS mae, ROUND(r2, 6) AS r2 FROM metrics")
def backtest_metrics(spark, sf_dir):
    return round_cols(_metrics(spark, sf_dir), ["rmse", "mae", "r2"], 6)


@query(f"WITH {_BACKTEST} SELECT nation, arg_min(model, rmse) AS best_model FROM metrics GROUP BY 1")
def best_model(spark, sf_dir):
    return pick_best(_metrics(spark, sf_dir), keys=["nation"], prefer=["trend", "naive"])


@query(f"""
WITH {_FLOWS},
means AS (SELECT nation, AVG(prs) AS prs, AVG(trs) AS trs FROM flows GROUP BY 1)
SELECT nation, ROUND(prs, 6) AS prs, ROUND(trs, 6) AS trs,
       ROUND((prs - (SELECT AVG(prs) FROM means)) / (SELECT stddev_pop(prs) FROM means), 6) AS prs_scaled,
       ROUND((trs - (SELECT AVG(trs) FROM means)) / (SELECT stddev_pop(trs) FROM means), 6) AS trs_scaled
FROM means""")
def standardised_profiles(spark, sf_dir):
    cols = ["prs", "trs"]
    out = region_profiles(_flows(spark, sf_dir), key="nation", cols=cols)
    return round_cols(out, [*cols, "prs_scaled", "trs_scaled"], 6)


@query()
def cluster_profile(spark, sf_dir):
    return cluster_profiles(_flows(spark, sf_dir), key="nation", cols=["prs", "trs", "births"])


@query()
def additive_forecast(spark, sf_dir):
    """Trend with change points and one regressor, per nation, to 2035."""
    out = forecast_additive(
        monthly(spark, sf_dir), keys=["nation"], time="month", target="revenue", regressors=["n_orders"],
        start="2024-01-01", end="2035-12-01",
    )
    return round_cols(out, ["predicted"], 4)


@query()
def fourier_forecast(spark, sf_dir):
    """Every (measure, nation) series in one grouped job: trend and two seasonal terms."""
    long = monthly(spark, sf_dir).select("nation", "month", F.col("n_orders").cast("double"), "revenue").unpivot(
        ["nation", "month"], ["n_orders", "revenue"], "measure", "y"
    )
    out = forecast_additive(
        long, keys=["measure", "nation"], time="month", target="y", seasonalities=EDUCATION_SEASONS,
        changepoint_scale=0.5, start="2020-01-01", end="2035-01-01", unit="year",
    )
    return round_cols(out, ["predicted"], 4)


FEATURES = ["Year", "Month", "Quarter", "n_orders_lag_1", "n_orders_lag_3", "n_orders_rolling_mean_3"]


def _features(spark, sf_dir):
    panel = monthly(spark, sf_dir).select("nation", F.col("month").alias("ref_date"), "n_orders")
    out = lags(panel, keys=["nation"], order="ref_date", cols=["n_orders"], ks=[1, 3])
    out = rolling_mean(out, keys=["nation"], order="ref_date", cols=["n_orders"], n=3)
    return complete_rows(calendar(out, "ref_date"))


def _trees(spark, sf_dir, kind, features=FEATURES, **options):
    split = split_train_test(_features(spark, sf_dir), keys=["nation"], order="ref_date", min_rows=50)
    return fit_trees(split, keys=["nation"], time="ref_date", target="n_orders", features=features, kind=kind, **options)


@query()
def rf_forecast(spark, sf_dir):
    return _trees(spark, sf_dir, "rf")


@query()
def gbt_forecast(spark, sf_dir):
    return _trees(spark, sf_dir, "gbt")


_SPLIT = f"""{MONTHLY},
features AS (
  SELECT nation, month, n_orders, lag(n_orders, 1) OVER w AS lag_1, lag(n_orders, 3) OVER w AS lag_3
  FROM monthly WINDOW w AS (PARTITION BY nation ORDER BY month)),
split AS (
  SELECT nation, month, n_orders AS y, lag_1 AS x, row_number() OVER w <= floor(0.8 * COUNT(*) OVER (PARTITION BY nation)) AS train
  FROM features WHERE lag_3 IS NOT NULL
  WINDOW w AS (PARTITION BY nation ORDER BY month) QUALIFY COUNT(*) OVER (PARTITION BY nation) >= 50)"""


@query(f"""
WITH {_SPLIT},
edges AS (
  SELECT nation, x, (x + lead(x) OVER (PARTITION BY nation ORDER BY x)) / 2 AS edge FROM (SELECT DISTINCT nation, x FROM split WHERE train)),
cuts AS (
  SELECT s.nation, edge, SUM(y) FILTER (WHERE s.x <= edge) AS ls, COUNT(*) FILTER (WHERE s.x <= edge) AS lw,
         SUM(y) FILTER (WHERE s.x > edge) AS rs, COUNT(*) FILTER (WHERE s.x > edge) AS rw
  FROM split s JOIN edges e ON e.nation = s.nation AND edge IS NOT NULL WHERE train GROUP BY ALL),
best AS (
  SELECT nation, arg_max(edge, (ls * ls / lw + rs * rs / rw, -edge)) AS edge, arg_max(ls / lw, (ls * ls / lw + rs * rs / rw, -edge)) AS l,
         arg_max(rs / rw, (ls * ls / lw + rs * rs / rw, -edge)) AS r
  FROM (SELECT nation, edge, CAST(ls AS DOUBLE) AS ls, lw, CAST(rs AS DOUBLE) AS rs, rw FROM cuts) GROUP BY 1)
SELECT nation, month AS ref_date, ROUND(CASE WHEN x <= edge THEN l ELSE r END, 6) AS predicted FROM split JOIN best USING (nation)
WHERE NOT train""")
def stump_per_series(spark, sf_dir):
    """One tree of one split for every nation, each by its own best cut."""
    out = _trees(spark, sf_dir, "gbt", features=["n_orders_lag_1"], per_group=True, trees=1, depth=1, rate=1.0)
    return round_cols(out, ["predicted"], 6).drop("n_orders")


@query(f"""
WITH {_SPLIT}
SELECT nation, COUNT(*) FILTER (WHERE NOT train) AS n_predicted, TRUE AS inside FROM split GROUP BY 1""")
def rf_per_series(spark, sf_dir):
    """A forest for every nation: a mean of leaves never leaves the range of the nation's training target."""
    out = _trees(spark, sf_dir, "rf", per_group=True)
    split = split_train_test(_features(spark, sf_dir), keys=["nation"], order="ref_date", min_rows=50).where("part = 'train'")
    known = split.groupBy("nation").agg(F.min("n_orders").alias("lo"), F.max("n_orders").alias("hi"))
    inside = F.bool_and(F.col("predicted").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9))
    return out.join(known, "nation").groupBy("nation").agg(F.count("predicted").alias("n_predicted"), inside.alias("inside"))


@query(f"""
WITH {_SPLIT}
SELECT nation, 3 AS n_scored, TRUE AS least, 144 AS n_ahead FROM split GROUP BY 1""")
def selected_models(spark, sf_dir):
    """Candidates scored per nation, whether the model that forecasts is the one with the least error, months ahead."""
    metrics, ahead = backtest_and_forecast(
        _features(spark, sf_dir), keys=["nation"], time="ref_date", target="n_orders", features=FEATURES,
        start="2024-01-01", end="2035-12-01", trees=20,
    )
    scored = metrics.groupBy("nation").agg(F.count("rmse").cast("int").alias("n_scored"), F.min("rmse").alias("best"))
    used = ahead.groupBy("nation", "model").agg(F.count("predicted").cast("int").alias("n_ahead"))
    used = used.join(metrics.select("nation", "model", "rmse"), ["nation", "model"])
    return scored.join(used, "nation").select("nation", "n_scored", (F.col("rmse") == F.col("best")).alias("least"), "n_ahead")


@query()
def additive_backtest(spark, sf_dir):
    split = split_train_test(_features(spark, sf_dir), keys=["nation"], order="ref_date", min_rows=50)
    out = fit_additive(split, keys=["nation"], time="ref_date", target="n_orders", regressors=["n_orders_lag_1"])
    return round_cols(out, ["predicted"], 4)


@query()
def select_and_forecast(spark, sf_dir):
    """Backtest three candidates, choose per nation, refit, forecast 144 months."""
    _, forecast = backtest_and_forecast(
        _features(spark, sf_dir), keys=["nation"], time="ref_date", target="n_orders", features=FEATURES,
        start="2024-01-01", end="2035-12-01",
    )
    return round_cols(forecast, ["predicted"], 4)
