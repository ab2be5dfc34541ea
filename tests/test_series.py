import numpy as np
import pandas as pd
import pytest

from growthlens.operators.series import interpolate, lags, lags_and_means, position, rolling_mean


@pytest.fixture(scope="module")
def gaps(spark):
    """Random series with gaps, all-missing and one-row series; `day` is unique, `blk` rises with it."""
    rng = np.random.default_rng(7)
    rows = []
    for g in range(12):
        n = 1 if g == 0 else int(rng.integers(5, 40))
        days = np.sort(rng.choice(200, n, replace=False))
        for d in days:
            missing = g == 1 or rng.random() < 0.45
            rows.append((f"g{g}", int(d), int(d) // 9, None if missing else float(rng.integers(-50, 50))))
    rng.shuffle(rows)
    rows = [(str(a), int(b), int(c), None if d is None else float(d)) for a, b, c, d in rows]
    return spark.createDataFrame(rows, "g string, day int, blk int, v double").cache()


def _pandas(df):
    return df.toPandas().sort_values(["g", "day"]).reset_index(drop=True)


def _same(got, want):
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), equal_nan=True, rtol=1e-9)


@pytest.mark.parametrize("block_by", [None, "blk", "day"])
@pytest.mark.parametrize("direction", ["forward", "both"])
def test_interpolate_equals_pandas(gaps, block_by, direction):
    out = _pandas(interpolate(gaps, keys=["g"], order="day", cols=["v"], direction=direction, block_by=block_by))
    want = _pandas(gaps).groupby("g")["v"].transform(
        lambda s: s.interpolate(method="linear", limit_direction=direction)
    )
    _same(out["v"], want)


def test_interpolate_frame_scope_crosses_groups(gaps):
    out = interpolate(gaps, order=["day", "g"], cols=["v"], scope="frame").toPandas().sort_values(["day", "g"])
    want = gaps.toPandas().sort_values(["day", "g"])["v"].interpolate(method="linear")
    _same(out["v"], want)


@pytest.mark.parametrize("block_by", [None, "blk"])
def test_lags_and_rolling_equal_pandas(gaps, block_by):
    out = lags(gaps, keys=["g"], order="day", cols=["v"], ks=[1, 3, 6], block_by=block_by)
    out = _pandas(rolling_mean(out, keys=["g"], order="day", cols=["v"], n=3, block_by=block_by))
    base = _pandas(gaps)
    for k in (1, 3, 6):
        _same(out[f"v_lag_{k}"], base.groupby("g")["v"].shift(k))
    _same(out["v_rolling_mean_3"], base.groupby("g")["v"].transform(lambda s: s.rolling(3).mean()))


def test_frame_scope_lags_and_rolling(gaps):
    out = lags(gaps, order=["day", "g"], cols=["v"], ks=[1, 3], scope="frame")
    out = rolling_mean(out, order=["day", "g"], cols=["v"], n=3, scope="frame").toPandas().sort_values(["day", "g"])
    base = gaps.toPandas().sort_values(["day", "g"])["v"]
    for k in (1, 3):
        _same(out[f"v_lag_{k}"], base.shift(k))
    _same(out["v_rolling_mean_3"], base.rolling(3).mean())


@pytest.mark.parametrize("block_by", [None, "blk"])
def test_position_and_total(gaps, block_by):
    out = _pandas(position(gaps, keys=["g"], order="day", block_by=block_by, total="len"))
    by = _pandas(gaps).groupby("g")["day"]
    assert out["position"].tolist() == (by.cumcount() + 1).tolist()
    assert out["len"].tolist() == by.transform("size").tolist()


def test_null_keys_form_their_own_series(frame):
    df = frame([(None, 1, 1.0), (None, 2, None), (None, 3, 3.0), ("a", 1, 5.0)], "g string, day int, v double")
    for block_by in (None, "day"):
        out = interpolate(df, keys=["g"], order="day", cols=["v"], block_by=block_by)
        assert out.where("g is null and day = 2").first()["v"] == 2.0
        assert out.count() == 4


def test_unknown_options_are_rejected(gaps):
    with pytest.raises(ValueError):
        interpolate(gaps, keys=["g"], order="day", cols=["v"], direction="sideways")
    with pytest.raises(ValueError):
        lags(gaps, keys=["g"], order="day", cols=["v"], ks=[1], scope="nowhere")


def _windows(df):
    """The bracketed arguments of every window in the plan: expressions, partition (if any), order."""
    for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        if "Window [" in line:
            groups, depth, at = [], 0, line.index("Window [") + 7
            for i in range(at, len(line)):
                depth += {"[": 1, "]": -1}.get(line[i], 0)
                if line[i] == "]" and depth == 0:
                    groups.append(line[at : i + 1])
                elif line[i] == "[" and depth == 1:
                    at = i
            yield groups


@pytest.fixture
def small_cells(monkeypatch):
    """Cells of about eight rows, scanned in groups of eight, at three levels."""
    from growthlens.operators import series

    monkeypatch.setattr(series, "CELL_ROWS", 8)
    monkeypatch.setattr(series, "_DRAWN", 4)
    monkeypatch.setattr(series, "_GROUP_BITS", 3)
    monkeypatch.setattr(series, "_NUMBER_BITS", 9)
    return series


@pytest.fixture(scope="module")
def lopsided(spark):
    """One key holds nearly all rows, nearly all of them of one day; `id` orders the rows of a day."""
    rng = np.random.default_rng(3)
    rows = [("hot", 5, i) for i in range(900)] + [("hot", d, 2000 + d) for d in range(12)]
    rows += [(None, d, 3000 + d) for d in range(40)] + [(f"k{i}", i % 3, 4000 + i) for i in range(60)]
    rows = [(k, d, i, None if rng.random() < 0.6 else float(rng.integers(-50, 50))) for k, d, i in rows]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    return spark.createDataFrame(rows, "g string, day int, id int, v double").repartition(7).cache()


@pytest.mark.parametrize("scope", ["group", "frame"])
def test_cells_of_a_lopsided_table(lopsided, small_cells, scope):
    keys, order = (["g"], ["day", "id"]) if scope == "group" else ([], ["day", "g", "id"])
    sizes = [r["count"] for r in small_cells._celled(lopsided, keys, order).groupBy("__cell").count().collect()]
    assert max(sizes) <= 8 * 5 and len(sizes) > 900 / 8 / 2 and sum(sizes) == lopsided.count()
    how = {"order": order, "cols": ["v"], "scope": scope} | ({"keys": keys, "block_by": "day"} if scope == "group" else {})
    frames = [
        interpolate(lopsided, direction="both", **how),
        lags_and_means(lopsided, ks=[1, 7, 20], ns=[3, 12], **how),
    ]
    frames += [position(lopsided, keys=keys, order=order, block_by="day", total="n")] if keys else []
    for df in frames:
        assert all(len(groups) == 3 for groups in _windows(df))
    base = lopsided.toPandas().sort_values(["day", "g", "id"], na_position="first").reset_index(drop=True)
    # interpolate skips what has no known value at all, as pandas does
    by = base.groupby("g", dropna=False)["v"] if keys else None
    on = lambda f: by.transform(f) if keys else f(base["v"])
    out = [f.toPandas().set_index("id").loc[base["id"]].reset_index() for f in frames]
    _same(out[0]["v"], on(lambda x: x.interpolate(method="linear", limit_direction="both")))
    for k in (1, 7, 20):
        _same(out[1][f"v_lag_{k}"], on(lambda x: x.shift(k)))
    for n in (3, 12):
        _same(out[1][f"v_rolling_mean_{n}"], on(lambda x: x.rolling(n).mean()))
    if keys:
        assert out[2]["position"].tolist() == (base.groupby("g", dropna=False).cumcount() + 1).tolist()
        assert out[2]["n"].tolist() == base.groupby("g", dropna=False)["id"].transform("size").tolist()


def test_cells_do_not_depend_on_the_partitions(lopsided, small_cells):
    cells = lambda df: {r["id"]: r["__cell"] for r in small_cells._celled(df, ["g"], ["day", "id"]).select("id", "__cell").collect()}
    assert cells(lopsided) == cells(lopsided.repartition(3, "v"))
