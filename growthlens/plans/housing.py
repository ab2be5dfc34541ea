"""Households, housing starts, price index, housing types, feature table, housing forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.forecasting.backtest import backtest_and_forecast
from growthlens.functions.dates import month_start, month_year
from growthlens.functions.numbers import half_even, plain_number, to_number
from growthlens.functions.text import bracket_or_tail
from growthlens.operators.calendars import calendar, densify, split_quarters, upsample
from growthlens.operators.common import q, qs
from growthlens.operators.fills import fill_median
from growthlens.operators.joins import apply_aliases, merge_features
from growthlens.operators.pivots import pivot_panel
from growthlens.operators.project import complete_rows, keep_range, keep_values, numeric_cols, require
from growthlens.operators.series import interpolate, lags_and_means
from growthlens.plans.regions import HOUSEHOLD_ALIASES, REGIONS
from growthlens.session import materialised
from growthlens.sources.files import plain_path, read_tables, with_name_part
from growthlens.sources.sheets import read_sheet

LAST_YEAR = 2036
# Published column names, growth rates and tenures.
STARTS = ["Housing completions", "Housing starts", "Housing under construction"]
PRICE_INDEX = {
    "House only": "House only NHPI",
    "Land only": "Land only NHPI",
    "Total (house and land)": "Total (house and land) NHPI",
}
FEATURES = ["Number_of_Households", *STARTS, *PRICE_INDEX.values()]
# Columns of a household sheet by population growth scenario.
GROWTH_SCENARIOS = {"high": 2, "medium 1": 3, "medium 2": 4, "medium 3": 5, "medium 4": 6, "medium 5": 7, "low": 8}
# Columns of a raw tenure sheet by position: the label column comes first.
TENURE_COLUMNS = {
    "Year": 1,
    "Ownership rate": 2,
    "Total": 3,
    "Single-detached": 4,
    "Apartments": 5,
    "Other dwellings": 6,
    "Owners": 7,
    "Owner-Single-detached": 8,
    "Owner-Apartments": 9,
    "Owner-Other dwellings": 10,
    "Renter": 11,
    "Renter-Single-detached": 12,
    "Renter-Apartments": 13,
    "Renter-Other dwellings": 14,
}


def household_sheets(spark: SparkSession, path: str, *, growth_scenario: str = "high") -> DataFrame:
    """(region file part, Year, thousands of households): estimates and the medium headship projection."""
    rows = read_sheet(
        spark, path, columns={"Year": 1, "households": GROWTH_SCENARIOS[growth_scenario]}, skip=2, label_col=0,
        keep_labels=["Historical estimates", "Medium"],
    )
    rows = with_name_part(rows, r"number-of-households-canada-provinces-(.*?)(?:_.*)?\.csv$", "region")
    return rows.select("region", q("Year").try_cast("int").alias("Year"), to_number("households").alias("households")).where(
        q("Year").isNotNull()
    )


def yearly_households(sheets: DataFrame) -> DataFrame:
    """Gap-free yearly households to 2036, interpolated in thousands and rounded half to even."""
    dense = densify(sheets, time="Year", keys=["region"], unit="number", end=LAST_YEAR)
    filled = interpolate(dense, keys=["region"], order="Year", cols=["households"])
    whole = F.coalesce(half_even("households"), F.lit(0.0)).cast("bigint") * 1000
    return filled.withColumn("households", whole)


def households(sheets: DataFrame, *, aliases: Mapping[str, str] | DataFrame = HOUSEHOLD_ALIASES) -> DataFrame:
    """Monthly (REF_DATE, GEO, Number_of_Households) per region and for Canada, the sum of all regions."""
    yearly = yearly_households(sheets)
    national = yearly.groupBy("Year").agg(F.lit("Canada").alias("region"), F.sum("households").alias("households"))
    both = yearly.unionByName(national.select(*qs(yearly.columns)))
    named = apply_aliases(both, "region", aliases, out="GEO")
    dated = named.select(
        F.make_date("Year", F.lit(1), F.lit(1)).alias("REF_DATE"), "GEO", q("households").alias("Number_of_Households")
    )
    return upsample(dated, keys=["GEO"], time="REF_DATE", cols=["Number_of_Households"], fill="repeat").select(
        "REF_DATE", "GEO", "Number_of_Households"
    )


def housing_starts(
    raw: DataFrame, *, ordinal: Sequence[str], regions: Sequence[str] | None = REGIONS, first: str = "1976-01-01",
    null_as_zero: bool = True,
) -> DataFrame:
    """Monthly starts, completions and units under construction from quarterly counts."""
    rows = require(raw, ["REF_DATE", "GEO", "Housing estimates", "Type of unit", "VALUE", *ordinal])
    rows = rows.where(q("Type of unit") == "Total units").withColumns(
        {"REF_DATE": month_start(q("REF_DATE").try_cast("date")), "VALUE": to_number("VALUE")}
    )
    # The calendar runs over all regions of the input; the region filter follows it.
    edges = rows.agg(F.struct(F.min("REF_DATE").alias("lo"), F.max("REF_DATE").alias("hi"))).scalar()
    rows = keep_values(rows, "GEO", regions) if regions else rows
    wide = pivot_panel(
        rows, keys=["REF_DATE", "GEO"], category="Housing estimates", values=STARTS,
        value="VALUE", how="first", ordinal=list(ordinal),
    )
    dense = densify(wide, time="REF_DATE", keys=["GEO"], start=edges["lo"], end=edges["hi"])
    monthly = split_quarters(dense, keys=["GEO"], time="REF_DATE", cols=STARTS, null_as_zero=null_as_zero)
    return keep_range(monthly, "REF_DATE", F.lit(first).cast("date")).select("REF_DATE", "GEO", *qs(STARTS))


def price_index(raw: DataFrame, *, regions: Sequence[str] | None = REGIONS) -> DataFrame:
    """Monthly new-housing price index; a repeated (month, region, index) is an error."""
    rows = require(raw, ["REF_DATE", "GEO", "New housing price indexes", "VALUE"])
    rows = keep_values(rows, "GEO", regions) if regions else rows
    rows = rows.withColumns({"REF_DATE": month_year("REF_DATE"), "VALUE": to_number("VALUE")})
    return pivot_panel(
        rows.dropna(subset=["REF_DATE"]), keys=["REF_DATE", "GEO"], category="New housing price indexes",
        values=PRICE_INDEX, value="VALUE", how="strict",
    )


def housing_features(households: DataFrame, starts: DataFrame, prices: DataFrame) -> DataFrame:
    return merge_features([households, starts, prices], ["REF_DATE", "GEO"], "left")


def housing_types(spark: SparkSession, folder: str) -> DataFrame:
    """All tenure tables of a folder, region taken from the file name."""
    rows = read_tables(spark, folder, with_source=True)
    rows = rows.withColumn("Geo", bracket_or_tail(plain_path(q("source_file")))).drop("source_file")
    counts = [c for c in rows.columns if c not in ("Year", "Geo")]
    typed = rows.withColumns({c: plain_number(c) for c in counts} | {"Year": to_number("Year").cast("int")})
    return typed.dropna(subset=["Year"])


def future_housing_types(types: DataFrame, first: int = 2025, end: int = 2036) -> DataFrame:
    return keep_range(types, "Year", first, end, hi_inclusive=False)


def tenure_sheets(spark: SparkSession, path: str, *, labels: Sequence[str] = ("Historical estimates", "Medium")) -> DataFrame:
    """Clean tenure tables from raw report sheets: yearly to 2036, in dwellings, the rate in percent."""
    rows = read_sheet(spark, path, columns=TENURE_COLUMNS, skip=2, label_col=0, keep_labels=labels)
    rows = rows.withColumn("Geo", bracket_or_tail(plain_path(q("source_file"))))
    values = [c for c in TENURE_COLUMNS if c != "Year"]
    typed = rows.select(
        "Geo", q("Year").try_cast("int").alias("Year"), *[plain_number(c).alias(c) for c in values]
    ).dropna(subset=["Year"])
    dense = densify(typed, time="Year", keys=["Geo"], unit="number", end=LAST_YEAR)
    filled = interpolate(dense, keys=["Geo"], order="Year", cols=values, direction="both")
    scaled = {c: half_even(q(c) * (1 if c == "Ownership rate" else 1000)).cast("bigint") for c in values}
    return filled.withColumns(scaled)


def engineer_features(
    features: DataFrame, *, start: str = "1986-01-01", end: str = "2024-10-01", scope: str = "group"
) -> DataFrame:
    """Model table: gaps interpolated and then filled with medians, calendar parts, lags 1, 3, 6, rolling means.

    `scope="frame"` treats the date-major frame as one series across regions; the default keeps regions apart.
    """
    rows = keep_range(features, "REF_DATE", F.lit(start).cast("date"), F.lit(end).cast("date"))
    numbers = numeric_cols(rows)
    how: dict[str, Any] = {"keys": ["GEO"], "order": "REF_DATE"}
    if scope == "frame":
        how = {"order": ["REF_DATE", "GEO"], "scope": "frame"}
    # medians and rows are three readers of the interpolated panel
    rows, _ = materialised(interpolate(rows, cols=numbers, **how))
    rows = fill_median(rows, numbers)
    rows = calendar(rows, "REF_DATE")
    cols = [c for c in FEATURES if c in rows.columns]
    rows = lags_and_means(rows, cols=cols, ks=[1, 3, 6], ns=[3], **how)
    return complete_rows(rows)


def housing_forecast(
    engineered: DataFrame, *, start: str = "2024-01-01", end: str = "2035-12-01",
    candidates: Sequence[str] = ("additive", "rf", "gbt"), trees: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """(metrics, forecast) of households per region for 144 months."""
    features = [c for c in numeric_cols(engineered) if c != "Number_of_Households"]
    metrics, ahead = backtest_and_forecast(
        engineered, keys=["GEO"], time="REF_DATE", target="Number_of_Households", features=features, start=start,
        end=end, candidates=candidates, trees=trees,
    )
    metrics = metrics.withColumnsRenamed({"GEO": "Province", "model": "Model", "rmse": "RMSE", "mae": "MAE", "r2": "R2"})
    ahead = ahead.select(q("REF_DATE").alias("Date"), "GEO", q("predicted").alias("Number_of_Houses"))
    return metrics, ahead
