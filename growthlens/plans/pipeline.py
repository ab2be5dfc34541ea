"""The whole run: population, housing and education branches from raw files to tables and forecasts.

python -m growthlens.plans.pipeline RAW_DIR OUT_DIR
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from growthlens.forecasting.backtest import NotEnoughData
from growthlens.operators.stats import null_report
from growthlens.plans import education, housing, population
from growthlens.session import shared_tables
from growthlens.sources.files import ORDINAL, read_tables
from growthlens.sources.sinks import run_report, write_table

log = logging.getLogger(__name__)

# Raw inputs below RAW_DIR.
POPULATION = "Population Timeseries.csv"
OFFICIAL = "canada_population_data.csv"
AGES = ["Demographic_data/Age Gender Distribution Provinces.csv", "Demographic_data/Age Gender Distribution Canada.csv"]
HOUSEHOLDS = "household_numbers"
STARTS = "HousingStarted_Raw.csv"
PRICES = "NHPI.csv"
TYPES = "housing-types"
EDUCATION = {
    "educators": "education_datasets/Educators in public elementary and secondary schools.csv",
    "education_prices": "education_datasets/Education price index (EPI), elementary and secondary.csv",
    "expenditures": "education_datasets/Elementary and secondary private schools, by type of expenditure.csv",
    "graduation_rates": "education_datasets/graduation_rates",
    "participation_rates": "education_datasets/participation_rates",
}
OUTPUTS = [
    "demographics",
    "population_metrics",
    "households",
    "housing_starts",
    "price_index",
    "housing_features",
    "housing_engineered",
    "housing_metrics",
    "housing_forecast",
    "housing_types",
    "future_housing_types",
    *EDUCATION,
    "missing_regions",
    "education_features",
    "missing_values",
    "education_enhanced",
    "education_forecast",
]


def run_all(spark: SparkSession, raw: str, out: str, *, trees: int = 100, fmt: str = "parquet") -> DataFrame:
    """Run every branch whose inputs exist and report what was written. A branch without input is skipped; any other
    failure is raised. Each table is written once and later steps read it from there. With fmt="csv" every table is also
    published as CSV with text dates, below OUT_DIR/csv."""
    done: dict[str, str] = {}
    written: dict[str, tuple[str, int]] = {}

    def ordered(name: str) -> DataFrame:
        return read_tables(spark, f"{raw}/{name}", with_ordinal=True, on_bad="skip")

    def save(name: str, build: Callable[[], DataFrame]) -> None:
        with shared_tables(spark):  # what the plan stores for its own readers goes once the result is written
            try:
                df = build()
            except (AnalysisException, FileNotFoundError) as e:
                if isinstance(e, AnalysisException) and e.getCondition() != "PATH_NOT_FOUND":
                    raise
                log.warning("%s skipped: %s", name, e)
                return
            done[name] = f"{out}/{name}"
            written[name] = done[name], write_table(df, done[name])
        if fmt == "csv":
            write_table(spark.read.parquet(done[name]), f"{out}/csv/{name}", fmt=fmt)

    def back(name: str) -> DataFrame:
        if name not in done:
            raise FileNotFoundError(f"needs {name}")
        return spark.read.parquet(done[name])

    save(
        "demographics",
        lambda: population.demographics(ordered(POPULATION), ordered(OFFICIAL), *map(ordered, AGES), ordinal=ORDINAL),
    )
    save("population_metrics", lambda: population.population_metrics(back("demographics")))

    save("households", lambda: housing.households(housing.household_sheets(spark, f"{raw}/{HOUSEHOLDS}")))
    save("housing_starts", lambda: housing.housing_starts(ordered(STARTS), ordinal=ORDINAL))
    save("price_index", lambda: housing.price_index(ordered(PRICES)))
    save(
        "housing_features",
        lambda: housing.housing_features(back("households"), back("housing_starts"), back("price_index")),
    )
    save("housing_engineered", lambda: housing.engineer_features(back("housing_features")))
    if "housing_engineered" in done:
        try:
            metrics, ahead = housing.housing_forecast(back("housing_engineered"), trees=trees)
            save("housing_metrics", lambda: metrics)
            save("housing_forecast", lambda: ahead)
        except NotEnoughData as e:
            log.warning("housing forecast skipped: %s", e)
    save("housing_types", lambda: housing.housing_types(spark, f"{raw}/{TYPES}").orderBy("Year", "Geo"))
    save("future_housing_types", lambda: housing.future_housing_types(back("housing_types")))

    for name, path in EDUCATION.items():
        save(name, lambda name=name, path=path: getattr(education, name)(ordered(path), ordinal=ORDINAL))
    save("missing_regions", lambda: education.missing_regions({n: back(n) for n in EDUCATION if n in done}))
    save("education_features", lambda: education.education_features([back(n) for n in EDUCATION]))
    save("missing_values", lambda: null_report(back("education_features")))
    save("education_enhanced", lambda: education.enhance(back("education_features")))
    save("education_forecast", lambda: education.education_forecast(back("education_enhanced")))
    return run_report(spark, OUTPUTS, written)


if __name__ == "__main__":
    session = SparkSession.builder.appName("growthlens").getOrCreate()
    run_all(session, sys.argv[1], sys.argv[2]).show(len(OUTPUTS), truncate=False)
