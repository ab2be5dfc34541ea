"""Education tables, their merge, derived features and forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.forecasting.additive import EDUCATION_SEASONS, forecast_additive
from growthlens.functions.dates import year_of, year_start
from growthlens.functions.numbers import ratio, row_mean, to_number
from growthlens.operators.calendars import upsample
from growthlens.operators.common import q, qs
from growthlens.operators.fills import fill_means, repair
from growthlens.operators.joins import merge_features
from growthlens.operators.pivots import pivot_panel
from growthlens.operators.project import complete_rows, drop_sparse, drop_value, keep_range, keep_values, null_shares, numeric_cols, require, zeros_to_null
from growthlens.operators.series import interpolate
from growthlens.operators.splits import min_sample
from growthlens.operators.stats import iqr_filter
from growthlens.plans.regions import REGIONS
from growthlens.session import ensure_checkpoint_dir, materialised

# Categories as published.
WORK_STATUS = ["Full-time educators", "Part-time educators", "Total, work status"]
PRICE_CATEGORIES = [
    "Education price index (EPI)",
    "Fees and contractual services sub-index",
    "Instructional supplies sub-index",
    "Non-salary sub-index",
    "Non-teaching salaries sub-index",
    "Salaries and wages sub-index",
    "School facilities, supplies and services sub-index",
    "Teachers' salaries sub-index",
]
DROPPED_EXPENDITURE = "Capita outlay and debt charges"
EXPENDITURES = [DROPPED_EXPENDITURE, "Teachers salaries", "Total expenditures", "Total operating expenditures"]
GRADUATION = ["Extended-time", "On-time"]
INSTITUTIONS = ["College", "Elementary and/or High School", "University"]
PARTICIPATION_DIMENSIONS = ["Participation rate by type of institution attended", "Type of institution attended"]
_KEYS = ["REF_DATE", "GEO"]


def category_table(
    raw: DataFrame, category: str, values: Sequence[str], *, ordinal: Sequence[str], regions: Sequence[str] | None = REGIONS,
    only_listed: bool = False,
) -> DataFrame:
    """(REF_DATE year, GEO) with one column per category: the first known value of each cell in input order."""
    rows = require(raw, ["REF_DATE", "GEO", category, "VALUE", *ordinal])
    rows = keep_values(rows, "GEO", regions) if regions else rows
    if only_listed:
        rows = keep_values(rows, category, values)
    rows = rows.withColumns({"REF_DATE": year_of("REF_DATE"), "VALUE": to_number("VALUE")})
    return pivot_panel(
        rows, keys=_KEYS, category=category, values=values, value="VALUE", how="first", ordinal=list(ordinal)
    )


def educators(raw: DataFrame, *, ordinal: Sequence[str]) -> DataFrame:
    return category_table(raw, "Work status", WORK_STATUS, ordinal=ordinal)


def education_prices(raw: DataFrame, *, ordinal: Sequence[str]) -> DataFrame:
    return category_table(raw, "Index categories", PRICE_CATEGORIES, ordinal=ordinal)


def expenditures(raw: DataFrame, *, ordinal: Sequence[str]) -> DataFrame:
    wide = category_table(raw, "Type of expenditure", EXPENDITURES, ordinal=ordinal, only_listed=True)
    return interpolate(wide, keys=["GEO"], order="REF_DATE", cols=EXPENDITURES).drop(DROPPED_EXPENDITURE)


def graduation_rates(raw: DataFrame, *, ordinal: Sequence[str]) -> DataFrame:
    """On-time and extended-time rates of all genders together, gaps interpolated within the region."""
    if "Gender" in raw.columns:
        raw = keep_values(raw, "Gender", ["Total gender"])
    wide = category_table(raw, "Graduation rate", GRADUATION, ordinal=ordinal)
    return interpolate(wide, keys=["GEO"], order="REF_DATE", cols=GRADUATION)


def participation_rates(raw: DataFrame, *, ordinal: Sequence[str], dimension: str | None = None) -> DataFrame:
    """Participation by institution; `dimension` names the category column, by default the one the edition has."""
    dimension = dimension or next((d for d in PARTICIPATION_DIMENSIONS if d in raw.columns), PARTICIPATION_DIMENSIONS[0])
    raw = require(raw, ["REF_DATE", "GEO", dimension, "VALUE", *ordinal])
    rows = drop_value(raw, dimension, "Total participation rate")
    return category_table(rows, dimension, INSTITUTIONS, ordinal=ordinal)


def missing_regions(tables: Mapping[str, DataFrame], regions: Sequence[str] = REGIONS) -> DataFrame:
    """(table, GEO) of every region that has no row in a table: its file may hold another region's rows."""
    if not tables:
        raise FileNotFoundError("no education table was written")
    wanted = [(n, g) for n in tables for g in regions]
    seen = reduce(DataFrame.union, [t.select(F.lit(n).alias("table"), "GEO").distinct() for n, t in tables.items()])
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(wanted, "table string, GEO string").join(seen, ["table", "GEO"], "left_anti").orderBy("table", "GEO")


def education_features(tables: Sequence[DataFrame]) -> DataFrame:
    """Outer merge of yearly tables on 1 January of the year and region."""
    dated = [t.withColumn("REF_DATE", year_start("REF_DATE")).dropna(subset=["REF_DATE"]) for t in tables]
    return merge_features(dated, _KEYS, "full")


def enhance(merged: DataFrame, *, max_null: float = 0.9, zeros_as_null: bool = False) -> DataFrame:
    """Sparse columns dropped, gaps filled, five derived features added.

    The merge is computed once (an action) into a table, whose missing values are counted while it is written; fills and
    features read that. In the ratios a source value of 0 counts as missing; with `zeros_as_null` the source columns lose their zeros too.
    """
    stored, shares = materialised(merged, null_shares(merged))
    rows = drop_sparse(stored, max_null, shares)
    numbers = numeric_cols(rows)
    rows = interpolate(rows, keys=["GEO"], order="REF_DATE", cols=numbers)
    rows = fill_means(rows, keys=["GEO"], cols=numbers)
    have = set(rows.columns)
    features = {}
    for name, top, bottom in (
        ("Educator_to_OperatingSpending", "Total, work status", "Total operating expenditures"),
        ("Salary_to_EPI", "Teachers salaries", "Education price index (EPI)"),
        ("OpSpend_per_Educator", "Total operating expenditures", "Total, work status"),
    ):
        if {top, bottom} <= have:
            features[name] = ratio(top, bottom)
    attended = [c for c in INSTITUTIONS if c in have]
    if attended:
        nonzero = zeros_to_null(rows.withColumns({f"__{c}": q(c) for c in attended}), [f"__{c}" for c in attended])
        rows = nonzero.withColumn("Education_Access_Index", F.coalesce(row_mean([f"__{c}" for c in attended]), F.lit(0.0)))
        rows = rows.drop(*[f"__{c}" for c in attended])
    if {"Total expenditures", "Teachers' salaries sub-index"} <= have:
        features["Capital_Efficiency"] = ratio("Total expenditures", "Teachers' salaries sub-index")
    rows = rows.withColumns(features)
    return zeros_to_null(rows, numbers) if zeros_as_null else rows


def education_forecast(
    enhanced: DataFrame, *, first_year: int = 1991, start: str = "2020-01-01", end: str = "2035-01-01",
    min_rows: int = 10, how: str = "inner",
) -> DataFrame:
    """All numeric columns forecast for 1 January of each year, one column each.

    Columns and regions become one long table, so every series is cleaned and fitted in one grouped job. Series are
    upsampled to months, outliers dropped, short ones skipped, forecasts kept positive. `inner` keeps regions that have
    every forecast column, `outer` all.
    """
    rows = keep_range(enhanced, "REF_DATE", F.make_date(F.lit(first_year), F.lit(1), F.lit(1)))
    numbers = [c for c in numeric_cols(rows) if c != "Year"]
    long = rows.select(*_KEYS, *[q(c).cast("double").alias(c) for c in numbers]).unpivot(_KEYS, numbers, "column", "y")
    series = ["column", "GEO"]
    monthly = upsample(long, keys=series, time="REF_DATE", cols=["y"])
    # A series holds one row per month, so its quartiles have a bounded input.
    clean = min_sample(iqr_filter(monthly, keys=series, col="y", bounded=True), keys=series, min_rows=min_rows)
    ensure_checkpoint_dir(enhanced.sparkSession)
    clean = clean.checkpoint()
    ahead = forecast_additive(
        clean, keys=series, time="REF_DATE", target="y", seasonalities=EDUCATION_SEASONS, changepoint_scale=0.5,
        start=start, end=end, unit="year",
    ).withColumnRenamed("predicted", "y")
    ahead = repair(ahead, clean, keys=series, order="REF_DATE", col="y").checkpoint()
    done = {r["column"] for r in ahead.select("column").distinct().collect()}  # at most one row per column
    kept = [c for c in numbers if c in done]
    wide = pivot_panel(ahead, keys=_KEYS, category="column", values=kept, value="y", how="strict")
    return (complete_rows(wide, kept) if how == "inner" else wide).select(*_KEYS, *qs(kept))
