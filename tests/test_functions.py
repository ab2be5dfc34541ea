import datetime as dt

import pytest
from pyspark.sql import functions as F

from growthlens import functions as fn


def one(frame, value, expr, kind="string"):
    return frame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, want",
    [("Jan-81", dt.date(1981, 1, 1)), ("Jan-68", dt.date(2068, 1, 1)), ("Jan-69", dt.date(1969, 1, 1)),
     ("Dec-00", dt.date(2000, 12, 1)), ("2001-02-03", dt.date(2001, 2, 3)), ("2001-02", dt.date(2001, 2, 1)),
     ("soon", None), (None, None)],
)
def test_month_year(frame, text, want):
    assert one(frame, text, fn.month_year("x")) == want


@pytest.mark.parametrize("text, want", [("2016/2017", 2016), (" 1999", 1999), ("n/a", None), (None, None)])
def test_year_of(frame, text, want):
    assert one(frame, text, fn.year_of("x")) == want


def test_year_start_and_text(frame):
    assert one(frame, "1995", fn.year_start("x")) == dt.date(1995, 1, 1)
    assert one(frame, "19x5", fn.year_start("x")) is None
    assert one(frame, dt.date(2024, 3, 5), fn.iso_text("x", "dd-MM-yyyy"), "date") == "05-03-2024"


@pytest.mark.parametrize("text, want", [(" 12.5 ", 12.5), ("--", None), ("NaN", None), ("", None), (None, None)])
def test_to_number(frame, text, want):
    assert one(frame, text, fn.to_number("x")) == want


@pytest.mark.parametrize("text, want", [("1,02,810", 102810.0), ("1,234.5", 1234.5), ("--", None)])
def test_plain_number(frame, text, want):
    assert one(frame, text, fn.plain_number("x")) == want


@pytest.mark.parametrize("value, want", [(2.5, 2.0), (3.5, 4.0), (-2.5, -2.0), (2.4, 2.0), (None, None)])
def test_half_even(frame, value, want):
    assert one(frame, value, fn.half_even("x"), "double") == want


def test_rates_and_ratios(frame):
    df = frame([(6.0, 3.0), (6.0, 0.0), (None, 3.0), (6.0, None), (0.0, 3.0)], "a double, b double")
    out = df.select(fn.safe_rate("a", "b", 1000).alias("rate"), fn.ratio("a", "b").alias("ratio")).collect()
    assert [r.rate for r in out] == [2000.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.ratio for r in out] == [2.0, 0.0, 0.0, 0.0, 0.0]


def test_row_sum_and_mean(frame):
    df = frame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    out = df.select(fn.row_sum(["a", "b", "c"]).alias("s"), fn.row_mean(["a", "b", "c"]).alias("m")).collect()
    assert [(r.s, r.m) for r in out] == [(4.0, 2.0), (0.0, None)]


@pytest.mark.parametrize(
    "name, want",
    [("households-1976-2036-en(Nova Scotia).csv", "Nova Scotia"), ("households(Quebec).csv", "Quebec"),
     ("households-2015-Ontario.csv", "Ontario")],
)
def test_bracket_or_tail(frame, name, want):
    assert one(frame, name, fn.bracket_or_tail("x")) == want


def test_mapped(frame):
    assert one(frame, " BC ", fn.mapped("x", {"BC": "British Columbia"})) == "British Columbia"
    assert one(frame, "Yukon", fn.mapped(F.col("x"), {"BC": "British Columbia"})) is None
