"""Population and demographics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.forecasting.growth import growth_metrics
from growthlens.functions.dates import year_of, year_start
from growthlens.functions.numbers import to_number
from growthlens.operators.aggregates import keep_first, rollup
from growthlens.operators.common import join_back, q
from growthlens.operators.joins import apply_aliases, fill_from_row, patch_totals
from growthlens.operators.pivots import pivot_panel
from growthlens.operators.project import complete_rows, keep_range, keep_values, require
from growthlens.plans.regions import AGE_CATEGORIES, FLOW_COLUMNS

FIRST_YEAR = 1991
_TOTALS = [*FLOW_COLUMNS, "Population Estimate"]
_GENDERS = {"Men+": "Male_Population", "Women+": "Female_Population"}


def population_totals(timeseries: DataFrame, official: DataFrame, *, ordinal: Sequence[str]) -> DataFrame:
    """Yearly totals per region: first row per key, from 1991 on, national rows rebuilt from the provinces with the
    official population estimate."""

    def typed(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        df = require(df, ["Year", "Province", *_TOTALS, *extra])
        return df.withColumns(
            {"Year": year_of("Year"), "Province": F.trim("Province"), **{c: to_number(c) for c in _TOTALS}}
        )

    first = keep_first(typed(timeseries, ordinal), keys=["Year", "Province"], order=ordinal).drop(*ordinal)
    return patch_totals(
        keep_range(first, "Year", FIRST_YEAR),
        typed(official),
        key="Year",
        region="Province",
        total_name="Canada",
        sum_cols=FLOW_COLUMNS,
        keep_cols=["Population Estimate"],
    )


def age_structure(*tables: DataFrame) -> DataFrame:
    """Male, female and combined population per year, region and age category."""
    cols = ["REF_DATE", "GEO", "Gender", "Age group", "VALUE"]
    rows = require(tables[0], cols)
    for other in tables[1:]:
        rows = rows.unionByName(require(other, cols))
    rows = keep_values(rows, "Gender", _GENDERS).select(
        year_of("REF_DATE").alias("Year"),
        F.trim("GEO").alias("Province"),
        "Gender",
        q("Age group").alias("Age_Group"),
        to_number("VALUE").alias("Population"),
    )
    rows = keep_range(rows.dropna(subset=["Year", "Population"]), "Year", FIRST_YEAR)
    rows = apply_aliases(rows, "Age_Group", AGE_CATEGORIES, out="Age_Group_Category")
    wide = pivot_panel(
        rows, keys=["Year", "Province", "Age_Group", "Age_Group_Category"], category="Gender", values=_GENDERS,
        value="Population", how="sum",
    )
    wide = wide.withColumn("Combined_Population", q("Male_Population") + q("Female_Population"))
    sums = {c: ("sum", c) for c in (*_GENDERS.values(), "Combined_Population")}
    out = rollup(wide, ["Year", "Province", "Age_Group_Category"], sums)
    return out.select(year_start("Year").alias("REF_DATE"), "*")


def demographics(
    timeseries: DataFrame, official: DataFrame, *age_tables: DataFrame, ordinal: Sequence[str]
) -> DataFrame:
    """Age structure with the yearly totals of its region; totals a row lacks come from its All Ages row."""
    totals = population_totals(timeseries, official, ordinal=ordinal)
    out = join_back(age_structure(*age_tables), totals, ["Year", "Province"])
    return fill_from_row(out, keys=["Year", "Province"], flag=q("Age_Group_Category") == "All Ages", cols=_TOTALS)


def population_metrics(demographics: DataFrame, variant: str = "pipeline") -> DataFrame:
    return growth_metrics(demographics, variant)


def clean_demographics(raw: DataFrame) -> DataFrame:
    """Demographics table without rows that miss any value."""
    return complete_rows(raw)
