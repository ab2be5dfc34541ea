import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from growthlens.operators.calendars import (
    attach_year_values,
    calendar,
    carry_last,
    densify,
    future_calendar,
    spine,
    split_quarters,
    upsample,
)


def d(y, m, day=1):
    return dt.date(y, m, day)


@pytest.fixture
def panel(frame):
    return frame(
        [("a", d(2020, 2), 1.0), ("a", d(2020, 5), 4.0), ("b", d(2020, 1), 7.0), ("b", d(2020, 6), None)],
        "g string, t date, v double",
    )


def test_densify_equals_spine_left_join(panel):
    got = densify(panel, time="t", keys=["g"])
    want = spine(panel, time="t", keys=["g"]).join(panel, ["g", "t"], "left").select("g", "t", "v")
    assert got.count() == 12
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_densify_to_given_bounds_drops_rows_outside(panel):
    out = densify(panel, time="t", keys=["g"], start="2020-03-01", end="2020-08-01")
    assert {(r.g, r.t.month) for r in out.collect()} == {(g, m) for g in "ab" for m in range(3, 9)}


def test_densify_numbers(frame):
    out = densify(frame([("a", 2000, 1.0), ("a", 2003, 2.0)], "g string, y int, v double"), time="y", keys=["g"],
                  unit="number", end=2005)
    assert [(r.y, r.v) for r in out.orderBy("y").collect()] == [
        (2000, 1.0), (2001, None), (2002, None), (2003, 2.0), (2004, None), (2005, None)]


def test_densify_adds_no_shuffle_before_windows(panel):
    from growthlens.operators.series import interpolate

    out = interpolate(densify(panel, time="t", keys=["g"], start="2020-01-01", end="2020-06-01"), keys=["g"],
                      order="t", cols=["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_upsample_carries_short_series_to_the_common_end(frame):
    df = frame([("a", d(2000, 1), 12.0), ("a", d(2001, 1), 24.0), ("b", d(2000, 1), 5.0)], "g string, t date, v double")
    rows = {(r.g, r.t): r.v for r in upsample(df, keys=["g"], time="t", cols=["v"]).collect()}
    assert len(rows) == 26
    assert rows["a", d(2000, 4)] == 15.0 and rows["b", d(2001, 1)] == 5.0


def test_upsample_repeat(frame):
    out = upsample(frame([("a", d(2000, 1), 3.0)], "g string, t date, v double"), keys=["g"], time="t", cols=["v"],
                   fill="repeat")
    assert [(r.t.month, r.v) for r in out.orderBy("t").collect()] == [(m, 3.0) for m in range(1, 13)]


def test_split_quarters(frame):
    rows = [("a", d(2020, 1), 9.0), ("a", d(2020, 2), None), ("a", d(2020, 3), None),
            ("a", d(2020, 5), 8.0), ("a", d(2020, 7), None), ("a", d(2020, 8), 6.0)]
    df = frame(rows, "g string, t date, v double")
    keep = {r.t.month: r.v for r in split_quarters(df, keys=["g"], time="t", cols=["v"], null_as_zero=False).collect()}
    assert keep == {1: 3.0, 2: 3.0, 3: 3.0, 5: 8.0, 7: None, 8: 6.0}
    zero = {r.t.month: r.v for r in split_quarters(df, keys=["g"], time="t", cols=["v"]).collect()}
    assert zero == {1: 3.0, 2: 3.0, 3: 3.0, 5: 8.0, 7: 0.0, 8: 0.0}


def test_complete_quarters_keep_their_sum(frame):
    months = pd.date_range("2019-01-01", periods=24, freq="MS")
    rows = [("a", t.date(), float(i) if t.month in (1, 4, 7, 10) else None) for i, t in enumerate(months)]
    out = split_quarters(frame(rows, "g string, t date, v double"), keys=["g"], time="t", cols=["v"])
    sums = out.groupBy(F.trunc("t", "quarter")).agg(F.sum("v").alias("s"))
    assert sorted(r.s for r in sums.collect()) == pytest.approx([0.0, 3.0, 6.0, 9.0, 12.0, 15.0, 18.0, 21.0])


def test_calendar_features(frame):
    r = calendar(frame([(d(2021, 11, 5),)], "t date"), "t").first()
    assert (r.Year, r.Month, r.Quarter, r.Day) == (2021, 11, 4, 5)


def test_carry_last_and_future_calendar(panel):
    out = carry_last(panel, keys=["g"], order="t", cols=["v"], time="t", unit="month", start="2024-01-01",
                     end="2024-03-01")
    assert {(r.g, r.t.month, r.v) for r in out.collect()} == {("a", m, 4.0) for m in (1, 2, 3)} | {
        ("b", m, None) for m in (1, 2, 3)}
    years = future_calendar(panel.select("g").distinct(), time="t", unit="year", start="2020-01-01", end="2035-01-01")
    assert years.count() == 32


def test_attach_year_values(panel, frame):
    yearly = frame([("a", 2020, 10.0)], "g string, y int, total double")
    rows = {(r.g, r.t.month): r.total for r in attach_year_values(panel, yearly, keys=["g"], time="t", year="y").collect()}
    assert rows == {("a", 2): 10.0, ("a", 5): 10.0, ("b", 1): None, ("b", 6): None}


@pytest.mark.parametrize("days, match", [(["2020-01-01", "2020-02-15"], "not on the calendar: a, 2020-02-15"), (["2020-01-01"] * 2, "occurs twice: a")])
def test_densify_names_steps_it_can_not_place(frame, days, match):
    rows = frame([("a", dt.date.fromisoformat(d), 1.0) for d in days], "k string, t date, v double")
    with pytest.raises(Exception, match=match):
        densify(rows, time="t", keys=["k"]).collect()
