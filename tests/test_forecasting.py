import datetime as dt

import numpy as np
import pandas as pd
import pytest

from growthlens.forecasting import (
    backtest_and_forecast,
    cluster_profiles,
    fit_additive,
    fit_trees,
    fit_trend,
    forecast_additive,
    forecast_trees,
    forecast_trend,
    growth_metrics,
    pick_best,
    score,
    what_if,
)
from growthlens.operators.splits import split_train_test

MONTHS = [t.date() for t in pd.date_range("2010-01-01", periods=72, freq="MS")]


@pytest.fixture(scope="module")
def panel(spark):
    """Two regions with a clean trend (one with a yearly wave), one too short to split."""
    rows = []
    for i, t in enumerate(MONTHS):
        days = (t - MONTHS[0]).days
        rows.append(("line", t, 100.0 + 0.5 * days, float(i), float(t.month)))
        rows.append(("wave", t, float(500.0 + 0.1 * days + 40 * np.sin(2 * np.pi * days / 365.25)), float(i), float(t.month)))
        if i < 20:
            rows.append(("short", t, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "g string, t date, y double, x double, month double").cache()


@pytest.fixture(scope="module")
def split(panel):
    return split_train_test(panel, keys=["g"], order="t", min_rows=50).cache()


COMMON = {"keys": ["g"], "time": "t", "target": "y"}


def test_trend_is_exact_on_a_line(panel, split):
    test = fit_trend(split, **COMMON).where("g = 'line'").toPandas()
    assert len(test) == 72 - 57
    np.testing.assert_allclose(test["predicted"], test["y"])
    ahead = forecast_trend(panel, **COMMON, start="2030-01-01", end="2030-12-01").where("g = 'line'").toPandas()
    want = [100.0 + 0.5 * (t - MONTHS[0]).days for t in ahead["t"]]
    assert len(ahead) == 12
    np.testing.assert_allclose(ahead["predicted"], want)


def test_additive_follows_trend_and_season(split):
    plain = score(fit_additive(split, **COMMON), keys=["g"], actual="y", predicted="predicted")
    waves = fit_additive(split, seasonalities=[("yearly", 365.25, 3)], changepoint_scale=0.01, **COMMON)
    waves = score(waves, keys=["g"], actual="y", predicted="predicted")
    plain, waves = ({r.g: r for r in df.collect()} for df in (plain, waves))
    assert set(plain) == {"line", "wave"}
    assert plain["line"].r2 > 0.99
    assert waves["wave"].rmse < 5 < plain["wave"].rmse


def test_additive_holds_regressors_and_skips_missing_targets(spark):
    rows = [("a", t, None if i in (3, 30) else 10.0 * i, 5.0) for i, t in enumerate(MONTHS)]
    df = spark.createDataFrame(rows, "g string, t date, y double, x double")
    out = forecast_additive(df, **COMMON, regressors=["x"], start="2016-01-01", end="2016-06-01").orderBy("t").toPandas()
    np.testing.assert_allclose(out["predicted"], [10.0 * i for i in range(72, 78)], rtol=0.02)
    none = df.selectExpr("g", "t", "cast(null as double) y")
    assert forecast_additive(none, **COMMON, start="2016-01-01", end="2016-06-01").count() == 0


def test_additive_runs_on_many_keys_at_once(panel):
    long = panel.selectExpr("g", "t", "y", "x").unpivot(["g", "t"], ["y", "x"], "column", "v")
    out = forecast_additive(long, keys=["column", "g"], time="t", target="v", start="2016-01-01", end="2018-01-01", unit="year")
    assert out.count() == 2 * 3 * 3


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_trees_predict_inside_the_observed_range(split, kind):
    options = {"features": ["x", "month"], "kind": kind, "trees": 5, "depth": 4}
    out = fit_trees(split, **COMMON, **options).toPandas()
    assert len(out) == 30 and out["predicted"].notna().all()
    train = split.where("part = 'train' and g = 'line'").toPandas()["y"]
    line = out[out["g"] == "line"]["predicted"]
    assert (line <= train.max() * 1.05).all() and (line > train.mean()).all()
    again = fit_trees(split, **COMMON, **options).toPandas()
    pd.testing.assert_frame_equal(out.sort_values(["g", "t"], ignore_index=True), again.sort_values(["g", "t"], ignore_index=True))


def test_tree_forecast_carries_the_last_row(panel):
    out = forecast_trees(panel, **COMMON, features=["x"], trees=3, start="2024-01-01", end="2024-03-01").toPandas()
    assert len(out) == 9 and out.groupby("g")["predicted"].nunique().eq(1).all()
    with pytest.raises(ValueError):
        fit_trees(panel, **COMMON, features=["x"], kind="forest", part="g")


def test_score_matches_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)] + [("m", None, 1.0)], "k string, y double, p double")
    r = score(df, keys=["k"], actual="y", predicted="p").first()
    assert r.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert r.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert r.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


def test_pick_best_ignores_infinite_and_prefers_the_first_on_ties(frame):
    rows = [("a", "gbt", 1.0), ("a", "additive", 1.0), ("b", "rf", 2.0), ("b", "additive", float("inf")),
            ("c", "rf", None), ("d", "gbt", float("nan")), ("d", "rf", 9.0)]
    best = pick_best(frame(rows, "g string, model string, rmse double"), keys=["g"])
    assert {r.g: r.best_model for r in best.collect()} == {"a": "additive", "b": "rf", "d": "rf"}


def test_backtest_and_forecast(panel):
    metrics, ahead = backtest_and_forecast(
        panel, **COMMON, features=["x", "month"], candidates=("trend", "rf"), start="2024-01-01", end="2035-12-01", trees=3
    )
    assert {(r.g, r.model) for r in metrics.collect()} == {(g, m) for g in ("line", "wave") for m in ("trend", "rf")}
    counts = {(r.g, r.model): r["count"] for r in ahead.groupBy("g", "model").count().collect()}
    assert counts == {("line", "trend"): 144, ("wave", "trend"): 144}


def test_clusters_separate_distant_regions(frame):
    rows = [(f"r{i}", float(base + j)) for i, base in enumerate([0, 1, 100, 101, 1000]) for j in range(3)]
    out = cluster_profiles(frame(rows, "g string, v double"), key="g", cols=["v"], k=3, restarts=3)
    c = {r.g: r.cluster for r in out.collect()}
    assert c["r0"] == c["r1"] and c["r2"] == c["r3"] and len(set(c.values())) == 3


FLOWS = "`Total PRs` double, `Total TRs` double, `Total Births` double, `Total Deaths` double, `Population Estimate` double"


@pytest.fixture
def flows(frame):
    return frame([(100.0, 40.0, 30.0, 10.0, 1000.0), (0.0, 40.0, 30.0, 10.0, 1000.0), (100.0, 40.0, None, 10.0, 0.0)], FLOWS)


def _metrics(df, variant):
    cols = ["Net Migration", "Natural Increase", "Net Population Change", "Net Migration Rate", "Natural Growth Rate",
            "Population Growth Rate (%)"]
    return [tuple(r[c] for c in cols) for r in growth_metrics(df, variant).collect()]


def test_growth_variants(flows):
    assert _metrics(flows, "pipeline") == [
        (60.0, 20.0, 80.0, 60.0, 20.0, 8.0), (-40.0, 20.0, -20.0, -40.0, 20.0, -2.0), (60.0, None, None, 0.0, 0.0, 0.0)]
    assert _metrics(flows, "notebook")[:2] == [(60.0, 20.0, 80.0, 60.0, 20.0, 8.0), (0.0, 20.0, 20.0, 0.0, 20.0, 2.0)]
    assert _metrics(flows, "documented")[:2] == [(140.0, 20.0, 160.0, 14.0, 2.0, 16.0), (0.0, 20.0, 0.0, 0.0, 2.0, 0.0)]
    share = growth_metrics(flows, "documented").first()
    assert (share["Net Migration %"], share["Natural Increase %"], share["Net Population Change %"]) == (87.5, 12.5, 100.0)
    with pytest.raises(ValueError):
        growth_metrics(flows, "other")


def test_growth_with_absent_column_and_text(frame):
    df = frame([("100", "x", 5.0)], "`Total PRs` string, `Total TRs` string, `Population Estimate` double")
    r = growth_metrics(df).first()
    assert r["Natural Increase"] == 0.0 and r["Net Migration"] is None and r["Net Migration Rate"] == 0.0


def test_what_if(flows):
    out = what_if(flows.limit(1), [("base", 1, 1), ("no temporary", 1, 0), ("double", 2, 2)])
    assert {r.scenario: r["Net Migration"] for r in out.collect()} == {"base": 60.0, "no temporary": 100.0, "double": 120.0}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_dates_are_dates(panel):
    assert isinstance(forecast_trend(panel, **COMMON, start="2030-01-01", end="2030-01-01").first()["t"], dt.date)


def test_trees_take_any_number_of_series(spark):
    rows = spark.range(1500 * 4).selectExpr(
        "id div 4 AS g", "cast(id % 4 AS int) AS t", "cast(id div 4 AS double) AS y", "cast(id % 4 AS double) AS x",
        "if(id % 4 < 3, 'train', 'test') AS part",
    )
    out = fit_trees(rows, keys=["g"], time="t", target="y", features=["x"], trees=3, depth=6)
    assert out.count() == 1500
    assert out.selectExpr("avg(abs(predicted - y)) AS e").first()["e"] < 300  # 375 if no series were known


def _slow_tree(x, y, w, rows, asked, depth, leaf):
    """One tree by recursion over explicit row lists, for integer targets; fills leaf[row] for rows and asked."""
    weight = sum(w[i] for i in rows)
    total = sum(w[i] * y[i] for i in rows)
    for i in asked:
        leaf[i] = total / weight
    best = (1e-9 * sum(w[i] * y[i] ** 2 for i in rows), None)
    for f in range(len(x)) if depth else ():
        for cut in sorted({x[f][i] for i in asked}):
            left = [i for i in rows if x[f][i] <= cut]
            a, sa = sum(w[i] for i in left), sum(w[i] * y[i] for i in left)
            if a < 1 or weight - a < 1:
                continue
            gain = sa**2 / a + (total - sa) ** 2 / (weight - a) - total**2 / weight
            if gain > best[0] * (1 + 1e-12) + (1e-9 * sum(w[i] * y[i] ** 2 for i in rows) if best[1] else 0):
                best = (gain, (f, cut))
    if best[1]:
        f, cut = best[1]
        for side in (True, False):
            pick = lambda of: [i for i in of if (x[f][i] <= cut) == side]  # noqa: B023, E731
            _slow_tree(x, y, w, pick(rows), pick(asked), depth - 1, leaf)


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_series_trees_equal_recursion(kind):
    from growthlens.forecasting import series_trees as st

    rng = np.random.default_rng(6)
    sizes = [30, 1, 17, 44]
    series = np.repeat(np.arange(4), sizes)
    n = len(series)
    x = np.stack([rng.integers(0, 9, n), rng.normal(size=n), rng.integers(0, 2, n)]).astype(float)
    y = rng.integers(-20, 20, n).astype(float)
    train = rng.random(n) < 0.8
    train[30] = False  # the series of one row has nothing to learn from
    row = rng.integers(-(2**62), 2**62, n)
    how = {"kind": kind, "trees": 6, "depth": 3, "rate": 0.5, "seed": 1}
    got = st.predicted(x, np.where(train, y, 0), train, series, row, **how)
    assert np.isnan(got[30])
    for s in (0, 2, 3):
        at = np.flatnonzero(series == s)
        bins = [st.binned(f[at], train[at], series[at]).tolist() for f in x]
        # every cut between two training values is a bin of its own
        assert all(len(set(b)) <= len(np.unique(f[at][train[at]])) for b, f in zip(bins, x))
        w, own, total = train[at].astype(float), y[at], np.zeros(len(at))
        if kind == "gbt":
            total += own[train[at]].mean()
        for tree in range(6):
            leaf = np.zeros(len(at))
            weight = w * st._draws(row[at], tree, 1) if kind == "rf" else w
            residual = own if kind == "rf" else own - total
            rows = [i for i in range(len(at)) if weight[i]]
            _slow_tree(bins, residual, weight, rows, list(range(len(at))), 3, leaf)
            total += leaf / 6 if kind == "rf" else 0.5 * leaf
        np.testing.assert_allclose(got[at], total, rtol=1e-9, atol=1e-9)


def test_series_do_not_depend_on_their_block(spark, monkeypatch):
    from growthlens.forecasting import series_trees as st

    rows = spark.range(3000).selectExpr(
        "concat('g', id % 60) AS g", "CAST(id DIV 60 AS INT) AS t", "CAST(id * 7919 % 101 AS DOUBLE) AS y", "CAST(id % 13 AS DOUBLE) AS x",
        "if(id DIV 60 < 40, 'train', 'test') AS part",
    )
    how = {"keys": ["g"], "time": "t", "target": "y", "features": ["x"], "trees": 8, "depth": 3, "per_group": True}
    whole = fit_trees(rows, **how).toPandas().sort_values(["g", "t"], ignore_index=True)
    monkeypatch.setattr(st, "BLOCK_ROWS", 70)
    split = fit_trees(rows.repartition(5), **how).toPandas().sort_values(["g", "t"], ignore_index=True)
    assert len(whole) == 600
    pd.testing.assert_frame_equal(whole, split)
    one = fit_trees(rows.where("g = 'g7'"), **how).toPandas().sort_values("t", ignore_index=True)
    pd.testing.assert_frame_equal(one, whole[whole["g"] == "g7"].reset_index(drop=True))


def test_series_trees_take_no_job_per_series(spark):
    """Nothing runs while the plan is built, and the plan is the same for 10 and for 1000 series."""
    context, plans = spark.sparkContext, []
    for n in (10, 1000):
        rows = spark.range(n * 20).selectExpr(f"id % {n} g", f"id DIV {n} t", "id % 17 y", "id % 5 x", f"if(id DIV {n} < 15, 'train', 'test') part")
        context.setJobGroup(f"trees-{n}", "")
        out = fit_trees(rows, keys=["g"], time="t", target="y", features=["x"], trees=2, depth=2, per_group=True)
        assert not context.statusTracker().getJobIdsForGroup(f"trees-{n}")
        assert out.count() == n * 5
        plans.append(len(context.statusTracker().getJobIdsForGroup(f"trees-{n}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert plans[0] == plans[1]


def test_series_trees_of_missing_and_odd_rows(frame):
    rows = [("a", 1, 1.0, 0.0, "train"), ("a", 2, None, 0.0, "train"), ("a", 3, 5.0, 1.0, "train"), ("a", 4, None, 1.0, "test"),
            ("a", 5, 9.0, None, "test"), (None, 1, 2.0, 0.0, "train"), (None, 2, None, 0.0, "test"), ("b", 1, None, 0.0, "test")]
    df = frame(rows, "g string, t int, y double, x double, part string")
    out = fit_trees(df, keys=["g"], time="t", target="y", features=["x"], kind="gbt", trees=1, depth=1, rate=1.0, per_group=True)
    assert sorted((str(r.g), r.t, r.predicted) for r in out.collect()) == [("None", 2, 2.0), ("a", 4, 5.0)]
    assert fit_trees(df.limit(0), keys=["g"], time="t", target="y", features=["x"], per_group=True).count() == 0


def test_only_winners_are_refitted(panel, monkeypatch):
    from growthlens.forecasting import backtest

    seen = {}

    def spy(df, **options):
        seen[options["kind"]] = (df.count(), {r.g for r in df.select("g").distinct().collect()}, options["per_group"])
        return forecast_trees(df, **options)

    monkeypatch.setattr(backtest, "forecast_trees", spy)
    metrics, ahead = backtest_and_forecast(
        panel, **COMMON, features=["x", "month"], candidates=("rf", "gbt"), start="2024-01-01", end="2024-12-01", trees=5
    )
    best = {r.g: r.best_model for r in pick_best(metrics, keys=["g"], prefer=["rf", "gbt"]).collect()}
    assert set(seen) == set(best.values())
    for model, (n, series, per_group) in seen.items():
        assert per_group and series == {g for g, m in best.items() if m == model} and n == 72 * len(series)
    assert ahead.count() == 12 * len(best)
