"""Fills, quantiles, outliers, reports, splits."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from growthlens.operators import stats
from growthlens.operators.fills import fill_constant, fill_group_stat, fill_means, fill_median, repair
from growthlens.operators.splits import min_sample, split_train_test

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]
NAMES = ["p0", "p5", "p25", "p50", "p75", "p100"]


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 10, 101])
def test_quantiles_of_small_groups(spark, n):
    rng = np.random.default_rng(n)
    values = {g: rng.integers(0, 30, n).astype(float) for g in "ab"}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    out = stats.quantiles(df, keys=["g"], col="v", probs=PROBS, names=NAMES)
    for r in out.collect():
        assert r.n == n
        np.testing.assert_allclose([r[c] for c in NAMES], np.quantile(values[r.g], PROBS))


def test_quantiles_of_a_hot_group_with_ties(spark):
    """One key holds nearly all rows and one value a third of those; far above the size where the sketch is exact."""
    df = spark.range(0, 120_000).select(
        F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("g"),
        F.when(F.col("id") % 3 == 0, 17.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(104729)) / 7.0).alias("v"),
    )
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    out = stats.quantiles(df, keys=["g"], col="v", probs=PROBS, names=NAMES)
    for r in out.collect():
        np.testing.assert_allclose([r[c] for c in NAMES], want[r.g])
    whole = stats.quantiles(df, keys=(), col="v", probs=[0.5], names=["m"]).first()["m"]
    assert whole == df.select(F.percentile("v", 0.5)).first()[0]


def test_quantiles_bounded_and_nulls(frame):
    df = frame([("a", 1.0), ("a", None), ("a", 2.0), ("b", None)], "g string, v double")
    for bounded in (True, False):
        out = stats.quantiles(df, keys=["g"], col="v", probs=[0.5], names=["m"], bounded=bounded).where("g = 'a'")
        assert [(r.n, r.m) for r in out.collect()] == [(2, 1.5)]


def test_iqr_bounds_are_inclusive(frame):
    # q1 = 2, q3 = 4, fence -1 .. 7
    df = frame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, 7.0)] + [("a", None)], "g string, v double")
    q1, q3 = np.quantile([1, 2, 3, 4, 7], [0.25, 0.75])
    assert q3 + 1.5 * (q3 - q1) == 7
    for keys, bounded in ((["g"], True), (["g"], False), ([], False)):
        assert stats.iqr_filter(df, keys=keys, col="v", bounded=bounded).count() == 5
        flags = stats.iqr_filter(df, keys=keys, col="v", k=1.4, action="flag", bounded=bounded)
        assert {r.v: r.outlier for r in flags.collect()} == {1.0: False, 2.0: False, 3.0: False, 4.0: False, 7.0: True, None: False}


def test_zscore_group_and_frame(frame):
    values = [1.0, 2.0, 3.0, 4.0, 30.0]
    df = frame([("a", v) for v in values] + [("b", 1.0)], "g string, v double")
    got = {(r.g, r.v): r for r in stats.zscore(df, ["v"], keys=["g"], threshold=1.5).collect()}
    z = (np.array(values) - np.mean(values)) / np.std(values, ddof=1)
    for v, want in zip(values, z):
        assert got["a", v].v_zscore == pytest.approx(want)
        assert got["a", v].v_outlier == (abs(want) > 1.5)
    assert got["b", 1.0].v_zscore is None and got["b", 1.0].v_outlier is False
    assert stats.zscore(df, ["v"]).count() == 6


def test_null_report_profile_distribution(frame):
    df = frame([("a", 1.0, None), ("a", 2.0, None), ("b", 4.0, 1.0)], "g string, v double, w double")
    assert [tuple(r) for r in stats.null_report(df).collect()] == [("w", 2, pytest.approx(200 / 3))]
    p = {r.column: r for r in stats.profile(df).collect()}
    assert (p["v"]["count"], p["v"]["distinct"], p["v"]["min"], p["v"]["max"], p["v"]["q50"]) == (3, 3, 1.0, 4.0, 2.0)
    assert p["v"]["mean"] == pytest.approx(7 / 3) and p["w"]["std"] is None
    d = stats.distribution(df, keys=["g"], col="v").where("g = 'a'").first()
    assert (d["min"], d["q25"], d["q50"], d["q75"], d["max"], d["n"]) == (1.0, 1.25, 1.5, 1.75, 2.0, 2)


def test_correlation_skips_missing_pairwise(frame):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.0, None), (3.0, 6.0, 1.0), (None, 1.0, 3.0)]
    out = stats.correlation(frame(rows, "a double, b double, c double"), ["a", "b", "c"])
    got = {(r.a, r.b): r.r for r in out.collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] == pytest.approx(-1.0)
    assert got["b", "c"] == pytest.approx(np.corrcoef([2, 6, 1], [5, 1, 3])[0, 1])


def test_fills(frame):
    df = frame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None), ("c", 10.0)], "g string, v double")
    # Group means first (a: 2), then the mean of 1, 2, 3, 10 for the group without values.
    filled = fill_means(df, keys=["g"], cols=["v"])
    assert sorted((r.g, r.v) for r in filled.collect()) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("c", 10.0)]
    assert sorted(r.v for r in fill_median(df, ["v"]).collect()) == [1.0, 3.0, 3.0, 3.0, 10.0]
    assert fill_constant(df, ["v"], 0).where("v = 0").count() == 2
    assert fill_group_stat(df, keys=["g"], cols=["v"], fn="max").where("g = 'a' and v = 3").count() == 2


def test_fill_means_of_nothing_stays_missing(frame):
    assert fill_means(frame([("a", None)], "g string, v double"), keys=["g"], cols=["v"]).first()["v"] is None


def test_repair(frame):
    forecast = frame([("a", 1, -5.0), ("a", 2, 2.0), ("a", 3, 0.0), ("a", 4, 6.0), ("b", 1, -1.0), ("c", 1, -1.0)],
                     "g string, t int, v double")
    history = frame([("a", 1.0), ("b", 10.0), ("b", 20.0), ("c", None)], "g string, v double")
    out = repair(forecast, history, keys=["g"], order="t", col="v")
    assert {(r.g, r.t): r.v for r in out.collect()} == {
        ("a", 1): 2.0, ("a", 2): 2.0, ("a", 3): 4.0, ("a", 4): 6.0, ("b", 1): 10.5, ("c", 1): 0.0}


@pytest.mark.parametrize("block_by", [None, "t"])
def test_splits(frame, block_by):
    df = frame([("a", t) for t in range(11)] + [("b", 0)], "g string, t int")
    out = split_train_test(df, keys=["g"], order="t", frac=0.8, min_rows=2, block_by=block_by)
    assert {r.t for r in out.where("part = 'train'").collect()} == set(range(8))
    assert out.where("g = 'b'").count() == 0
    last = split_train_test(df, keys=["g"], order="t", last_n=3, block_by=block_by).where("g = 'a' and part = 'test'")
    assert {r.t for r in last.collect()} == {8, 9, 10}
    assert min_sample(df, keys=["g"], min_rows=2).count() == 11


def test_unknown_action(frame):
    with pytest.raises(ValueError):
        stats.iqr_filter(frame([(1.0,)], "v double"), keys=[], col="v", action="hide")


def test_a_missed_bracket_is_an_error_not_a_value(spark, monkeypatch):
    monkeypatch.setattr(stats, "_bracket", lambda p: (0.9, 0.95))
    df = spark.range(1000).selectExpr("double(id) v")
    with pytest.raises(PySparkException, match="bracket missed"):
        stats.quantiles(df, keys=(), col="v", probs=[0.5], names=["m"]).collect()


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_exact_statistics_take_two_scans(spark, tmp_path):
    spark.range(500).selectExpr("id % 3 g", "double(id) a", "id * 2 b", "id % 7 c", "double(id % 5) d").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert _scans(stats.quantiles(df, keys=["g"], col="a", probs=[0.1, 0.5], names=["x", "y"])) == 2
    assert _scans(stats.distribution(df, keys=["g"], col="a")) == 2
    out = stats.profile(df, ["a", "b", "c", "d"])
    out.collect()
    # brackets and base figures come from one scan, in a subquery that its readers share
    assert "ReusedSubquery" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: (r["count"], r["distinct"], r["q50"]) for r in out.collect()} == {
        "a": (500, 500, 249.5), "b": (500, 500, 499.0), "c": (500, 7, 3.0), "d": (500, 5, 2.0)}


def test_profile_and_distribution_of_missing_values(frame):
    df = frame([("a", None, 1.0), ("a", None, None), ("b", None, -0.0)], "g string, v double, w double")
    rows = {r["column"]: tuple(r)[1:] for r in stats.profile(df).collect()}
    assert rows["v"] == (0, None, None, None, None, 0, None, None, None)
    assert rows["w"][0] == 2 and rows["w"][5] == 2
    for bounded in (True, False):
        out = {r["g"]: r for r in stats.distribution(df, keys=["g"], col="v", bounded=bounded).collect()}
        assert {g: (r["n"], r["min"], r["q50"]) for g, r in out.items()} == {"a": (None, None, None), "b": (None, None, None)}


def test_columns_are_ranked_together(spark):
    rng = np.random.default_rng(1)
    data = np.column_stack([rng.standard_normal(30_000), rng.exponential(1, 30_000) ** 3, rng.integers(0, 4, 30_000)])
    df = spark.createDataFrame(data.tolist(), "a double, b double, c double").repartition(4)
    rows = {r["__column"]: r for r in stats.ranked(df, [], ["a", "b", "c"], [0.5, 0.01, 0.999]).collect()}
    for i in range(3):
        np.testing.assert_allclose([rows[i][f"p{j}"] for j in range(3)], np.quantile(data[:, i], [0.5, 0.01, 0.999]))
