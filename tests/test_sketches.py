"""Merged sketches against exact figures."""

import numpy as np
import pytest

from growthlens.operators import sketches as sk

PROBS = [0.01, 0.25, 0.5, 0.9]
NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(2)
    return {"hot": np.round(rng.exponential(3, 60_000) ** 2, 3), "cold": rng.normal(size=500)}


def test_sketches_of_runs_merge_within_the_bound(spark, values):
    rows = [(g, i % 5, float(v)) for g, vs in values.items() for i, v in enumerate(vs)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(6)
    runs = [sk.sketches(df.where(f"day = {d}"), keys=["g", "day"], col="v", k=256) for d in range(5)]
    table = sk.merged(*runs, keys=["g"])
    out = {r.g: r for r in sk.estimates(table, keys=["g"], probs=PROBS, names=NAMES).collect()}
    for g, vs in values.items():
        assert out[g].n == len(vs)
        for p, n in zip(PROBS, NAMES):
            low, high = np.mean(vs < out[g][n]), np.mean(vs <= out[g][n])
            assert low - sk.rank_error(256) <= p <= high + sk.rank_error(256) and out[g][n] in vs
        assert out[g].distinct == pytest.approx(len(set(vs)), rel=4 * sk.distinct_error())
    assert (out["none"].n, out["none"].a, out["none"].distinct) == (0, None, 0)
    whole = sk.estimates(sk.merged(table, keys=[]), keys=[], probs=[0.5], names=["m"]).first()
    every = np.concatenate(list(values.values()))
    assert whole.n == len(every) and abs(np.mean(every <= whole.m) - 0.5) <= sk.rank_error(256)


def test_sketches_are_stored_and_read(spark, values, tmp_path):
    df = spark.createDataFrame([("a", float(v)) for v in values["cold"]], "g string, v double")
    sk.sketches(df, keys=["g"], col="v").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    out = sk.estimates(sk.merged(stored, stored, keys=["g"]), keys=["g"], probs=[0.0, 1.0], names=["lo", "hi"]).first()
    assert (out.n, out.lo, out.hi) == (1000, values["cold"].min(), values["cold"].max())
    assert out.distinct == pytest.approx(500, rel=0.02)


def test_bounds_follow_the_size():
    assert sk.rank_error(4096) < sk.rank_error(256) < 0.02 and sk.distinct_error(16) < sk.distinct_error(10)
