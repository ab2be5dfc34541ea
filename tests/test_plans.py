"""The domain jobs on small hand-made inputs in the published layouts."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from growthlens.plans import education, exploration, housing, pipeline, population
from growthlens.plans.regions import REGIONS

TOTALS = "Year string, Province string, `Total PRs` string, `Total TRs` string, `Total Births` string, `Total Deaths` string, `Population Estimate` string"
AGES = "REF_DATE string, GEO string, Gender string, `Age group` string, VALUE string"


def test_demographics(frame):
    series = frame(
        [("2000", " Ontario ", "10", "4", "3", "1", "100", 1), ("2000", "Ontario", "99", "99", "99", "99", "99", 2),
         ("2000", "Quebec", "5", None, "2", "1", "50", 3), ("2000", "Canada", "1", "1", "1", "1", "1", 4),
         ("1990", "Ontario", "1", "1", "1", "1", "1", 5)], TOTALS + ", n int")
    official = frame([("2000", "Canada", None, None, None, None, "27790000"), ("1996", "Canada", "7", "7", "7", "7", "7")], TOTALS)
    provinces = frame(
        [("2000", "Ontario", "Men+", "0 to 14 years", "7"), ("2000", "Ontario", "Women+", "0 to 14 years", "8"),
         ("2000", "Ontario", "Men+", "All ages", "50"), ("2000", "Ontario", "Women+", "All ages", None),
         ("2000", "Ontario", "Total", "All ages", "1"), ("2000", "Ontario", "Men+", "5 years", "1"),
         ("1985", "Ontario", "Men+", "All ages", "1"), ("year", "Ontario", "Men+", "All ages", "1")], AGES)
    canada = frame([("2000", "Canada", "Men+", "All ages", "500"), ("2000", "Canada", "Women+", "All ages", "510")], AGES)
    totals = {r.Province: r for r in population.population_totals(series, official, ordinal=["n"]).collect()}
    assert totals["Ontario"]["Total PRs"] == 10.0
    assert (totals["Canada"]["Total PRs"], totals["Canada"]["Total TRs"], totals["Canada"]["Population Estimate"]) == (15.0, 4.0, 27790000.0)
    out = population.demographics(series, official, provinces, canada, ordinal=["n"])
    got = {(r.Province, r.Age_Group_Category): r for r in out.collect()}
    assert set(got) == {("Ontario", "Children (0–14)"), ("Ontario", "All Ages"), ("Canada", "All Ages")}
    child, everyone = got["Ontario", "Children (0–14)"], got["Ontario", "All Ages"]
    assert (child.Combined_Population, child["Total Births"], child.REF_DATE) == (15.0, 3.0, dt.date(2000, 1, 1))
    assert (everyone.Male_Population, everyone.Female_Population, everyone.Combined_Population) == (50.0, 0.0, 0.0)
    metrics = population.population_metrics(out).where("Province = 'Canada'").first()
    assert metrics["Net Migration"] == 11.0
    assert population.clean_demographics(series).count() == 4


SHEET = """"Number of Households (000's)",,,,,,,,,
Headship,Population growth scenario,,,,,,,,
,Year,High growth,M1,M2,M3,M4,M5,Low growth,
Historical estimates,1996,{a},,,,,,,
,2001,{b},,,,,,,
High,2006,99,98,97,96,95,94,93,
Medium,2006,{c},1,2,3,4,5,6,
,2036,{d},1,2,3,4,5,6,
Low,2006,1,1,1,1,1,1,1,
,,,,,,,,,
Source,,,,,,,,,
"""


@pytest.fixture
def sheets(tmp_path):
    folder = tmp_path / "household_numbers"
    folder.mkdir()
    for name, values in {"NewBrunswick": (10, 20, 30, 33), "PEI": (1, 2, 2, 8), "Atlantis": (5, 5, 5, 5)}.items():
        text = SHEET.format(**dict(zip("abcd", values)))
        (folder / f"number-of-households-canada-provinces-{name}.csv").write_bytes(text.encode("latin-1"))
    return str(folder)


def test_households(spark, sheets):
    raw = housing.household_sheets(spark, sheets)
    assert raw.where("region = 'PEI'").count() == 4
    low = housing.household_sheets(spark, sheets, growth_scenario="low")
    assert {r.households for r in low.where("region = 'PEI' and Year = 2006").collect()} == {6.0}
    out = housing.households(raw)
    got = {(r.GEO, r.REF_DATE): r.Number_of_Households for r in out.where("month(REF_DATE) in (1, 12)").collect()}
    assert {g for g, _ in got} == {"New Brunswick", "Prince Edward Island", "Canada"}
    assert got["New Brunswick", dt.date(1998, 12, 1)] == 14000
    # 1.4 -> 1, 1.6 -> 2 and 2.2 -> 2; half values go to the even neighbour
    assert got["Prince Edward Island", dt.date(1998, 1, 1)] == 1000
    assert got["Prince Edward Island", dt.date(1999, 1, 1)] == 2000
    # The national sum counts the region whose name is unknown.
    assert got["Canada", dt.date(1996, 1, 1)] == 16000
    assert out.count() == 3 * 12 * 41


def _starts(frame):
    rows, n = [], 0
    for geo in ("Ontario", "Quebec", "Yukon"):
        for month, value in (("1975-10", "3"), ("1976-01", "9"), ("1976-07", "6")):
            for kind, factor in (("Housing starts", 1), ("Housing completions", 2)):
                n += 1
                rows.append((month, geo, kind, "Total units", str(int(value) * factor), "x", n))
        n += 1
        rows.append(("1976-01", geo, "Housing starts", "Single", "99", "x", n))
    return frame(rows, "REF_DATE string, GEO string, `Housing estimates` string, `Type of unit` string, VALUE string, DGUID string, n int")


def test_housing_starts(frame):
    out = housing.housing_starts(_starts(frame), ordinal=["n"])
    got = {r.REF_DATE: r for r in out.where("GEO = 'Ontario'").collect()}
    assert min(got) == dt.date(1976, 1, 1) and max(got) == dt.date(1976, 7, 1)
    assert [got[dt.date(1976, m, 1)]["Housing starts"] for m in range(1, 8)] == [3.0, 3.0, 3.0, 0.0, 0.0, 0.0, 2.0]
    assert got[dt.date(1976, 2, 1)]["Housing completions"] == 6.0
    assert got[dt.date(1976, 2, 1)]["Housing under construction"] == 0.0
    assert {r.GEO for r in out.select("GEO").distinct().collect()} == {"Ontario", "Quebec"}
    kept = housing.housing_starts(_starts(frame), ordinal=["n"], null_as_zero=False).where("GEO = 'Ontario'")
    assert {r.REF_DATE.month: r["Housing starts"] for r in kept.collect()}[5] is None


def test_price_index(frame):
    rows = [("Jan-81", "Ontario", "House only", "40.5"), ("Jan-81", "Ontario", "Land only", ".."),
            ("Feb-81", "Yukon", "House only", "1"), ("never", "Ontario", "House only", "2")]
    out = housing.price_index(frame(rows, "REF_DATE string, GEO string, `New housing price indexes` string, VALUE string"))
    assert [tuple(r) for r in out.collect()] == [(dt.date(1981, 1, 1), "Ontario", 40.5, None, None)]


def test_housing_types(spark, tmp_path):
    folder = tmp_path / "types"
    folder.mkdir()
    for geo in ("Ontario", "Nova Scotia"):
        text = 'Year,Total,Owners\n2024,"1,000",1\n2025,2000,2\n2036,3000,3\nnote,,\n'
        (folder / f"households-1976-2036-en({geo}).csv").write_text(text)
    types = housing.housing_types(spark, str(folder))
    assert sorted((r.Year, r.Geo) for r in types.collect())[:2] == [(2024, "Nova Scotia"), (2024, "Ontario")]
    assert types.where("Year = 2024").first()["Total"] == 1000.0
    future = housing.future_housing_types(types)
    assert {(r.Year, r.Geo, r.Total) for r in future.collect()} == {(2025, "Ontario", 2000.0), (2025, "Nova Scotia", 2000.0)}


def test_tenure_sheets(spark, tmp_path):
    folder = tmp_path / "tenure"
    folder.mkdir()
    values = lambda rate, n: ",".join([str(rate)] + [f'"{n}"'] * 12)
    text = "t,,\nh,,\n,Year,Rate\n" + f"Historical estimates,2030,{values(60, '1,000.5')}\nHigh,2034,{values(1, 1)}\nMedium,2034,{values(64, '1,002.5')}\n"
    (folder / "tenure-en(Canada).csv").write_text(text)
    out = housing.tenure_sheets(spark, str(folder)).orderBy("Year").collect()
    assert [r.Year for r in out] == list(range(2030, 2037))
    assert [r["Ownership rate"] for r in out] == [60, 61, 62, 63, 64, 64, 64]
    assert out[1]["Total"] == 1_001_000 and out[0]["Geo"] == "Canada"


@pytest.fixture(scope="module")
def features(spark):
    """Merged housing panel for three regions over eight years; the index starts late, one region has none."""
    rng = np.random.default_rng(1)
    rows = []
    for r, geo in enumerate(["Ontario", "Quebec", "Canada"]):
        for i, t in enumerate(pd.date_range("2015-01-01", periods=96, freq="MS")):
            starts = float(rng.integers(50, 100)) * (r + 1)
            index = None if geo == "Quebec" or i < 6 else 100.0 + i
            rows.append((t.date(), geo, 1000 * (r + 1) + 5 * i, starts * 0.8, None if i % 3 else starts, starts * 2, index, index, index))
    return spark.createDataFrame(
        rows, "REF_DATE date, GEO string, Number_of_Households bigint, `Housing completions` double, `Housing starts` double, "
        "`Housing under construction` double, `House only NHPI` double, `Land only NHPI` double, `Total (house and land) NHPI` double"
    ).cache()


@pytest.mark.parametrize("scope", ["group", "frame"])
def test_engineer_features_equals_pandas(features, scope):
    out = housing.engineer_features(features, scope=scope, start="2015-03-01").toPandas()
    p = features.toPandas()
    p = p[p["REF_DATE"] >= dt.date(2015, 3, 1)]
    keys = ["GEO", "REF_DATE"] if scope == "group" else ["REF_DATE", "GEO"]
    p = p.sort_values(keys).reset_index(drop=True)
    p["Number_of_Households"] = p["Number_of_Households"].astype(float)
    num = housing.FEATURES
    by = (lambda f: p.groupby("GEO")[num].transform(f)) if scope == "group" else (lambda f: p[num].apply(f))
    p[num] = by(lambda s: s.interpolate())
    p[num] = p[num].fillna(p[num].median())
    by = (lambda f: p.groupby("GEO")[num].transform(f)) if scope == "group" else (lambda f: p[num].apply(f))
    extra = {f"_lag_{k}": by(lambda s, k=k: s.shift(k)) for k in (1, 3, 6)} | {"_rolling_mean_3": by(lambda s: s.rolling(3).mean())}
    for suffix, values in extra.items():
        for c in num:
            p[c + suffix] = values[c]
    p = p.dropna().reset_index(drop=True)
    out = out.sort_values(keys).reset_index(drop=True)
    assert len(out) == len(p)
    for c in [c for c in p.columns if c not in ("REF_DATE", "GEO")]:
        np.testing.assert_allclose(out[c].astype(float), p[c], err_msg=c)
    assert {"Year", "Month", "Quarter", "Day"} <= set(out.columns)


def test_housing_forecast_and_comparison(features):
    engineered = housing.engineer_features(features)
    metrics, ahead = housing.housing_forecast(engineered, candidates=("additive", "rf"), trees=3)
    assert metrics.columns == ["Province", "Model", "RMSE", "MAE", "R2"] and metrics.count() == 6
    assert ahead.columns == ["Date", "GEO", "Number_of_Houses"] and ahead.count() == 3 * 144
    compared = exploration.compare_models(features, trees=3)
    assert {r.model for r in compared.collect()} == {"additive", "rf", "gbt"}


def test_exploration(features):
    out = exploration.housing_exploration(features.withColumn("GEO", F.when(F.col("GEO") == "Canada", "Canada").otherwise("Ontario")).union(
        features.where("GEO = 'Ontario'").withColumn("GEO", F.lit("Alberta"))).union(
        features.where("GEO = 'Canada'").withColumn("GEO", F.lit("Manitoba"))))
    assert out["summary"].count() == 7 and out["correlations"].count() == 21
    assert {r.GEO for r in out["clusters"].collect()} == {"Ontario", "Alberta", "Manitoba"}
    assert out["distributions"].count() == 3
    assert {"demand", "supply", "shortage"} <= set(out["supply_demand"].columns)
    assert out["outliers"].count() >= 0


RAW = "REF_DATE string, GEO string, {} string, VALUE string, n int"


def test_education_tables(frame):
    rows = [("2002/2003", "Ontario", "Full-time educators", "10", 1), ("2002/2003", "Ontario", "Full-time educators", "99", 2),
            ("2002/2003", "Ontario", "Part-time educators", "..", 3), ("2002/2003", "Nunavut", "Full-time educators", "1", 4)]
    out = education.educators(frame(rows, RAW.format("`Work status`")), ordinal=["n"])
    assert [tuple(r) for r in out.collect()] == [(2002, "Ontario", 10.0, None, None)]

    rows = [(str(y), "Quebec", "Total expenditures", v, i) for i, (y, v) in enumerate([(1947, None), (1948, "2"), (1949, None), (1950, "4"), (1951, None)])]
    rows.append(("1949", "Quebec", "Capita outlay and debt charges", "5", 9))
    spend = education.expenditures(frame(rows, RAW.format("`Type of expenditure`")), ordinal=["n"])
    assert education.DROPPED_EXPENDITURE not in spend.columns
    assert [r["Total expenditures"] for r in spend.orderBy("REF_DATE").collect()] == [None, 2.0, 3.0, 4.0, 4.0]

    grads = [("2016/2017", "Canada", "On-time", "80", 1, "Total gender"), ("2016/2017", "Canada", "On-time", "70", 0, "Male gender")]
    out = education.graduation_rates(frame(grads, RAW.format("`Graduation rate`") + ", Gender string"), ordinal=["n"])
    assert [tuple(r) for r in out.collect()] == [(2016, "Canada", None, 80.0)]

    for name in education.PARTICIPATION_DIMENSIONS:
        part = [("2022/2023", "Canada", "College", "9", 1), ("2021/2022", "Canada", "Total participation rate", "9", 2)]
        out = education.participation_rates(frame(part, RAW.format(f"`{name}`")), ordinal=["n"])
        assert [tuple(r) for r in out.collect()] == [(2022, "Canada", 9.0, None, None)]

    prices = education.education_prices(frame([("1971", "Canada", "Non-salary sub-index", "9", 1)], RAW.format("`Index categories`")), ordinal=["n"])
    assert len(prices.columns) == 10


def _education_tables(frame):
    years = range(1985, 2010)
    staff = [(y, g, 100.0 + y - 1985, 40.0) for y in years for g in ("Ontario", "Quebec")]
    spend = [(y, g, None if y % 2 else 1000.0 + 10 * (y - 1985), 0.0 if y == 1990 else 500.0) for y in years for g in ("Ontario", "Quebec")]
    part = [(y, "Ontario", 10.0, None, 30.0) for y in years]
    return [
        frame(staff, "REF_DATE int, GEO string, `Total, work status` double, `Part-time educators` double"),
        frame(spend, "REF_DATE int, GEO string, `Total operating expenditures` double, `Teachers salaries` double"),
        frame(part, "REF_DATE int, GEO string, College double, `Elementary and/or High School` double, University double"),
    ]


def test_enhance_and_forecast(frame):
    merged = education.education_features(_education_tables(frame))
    assert merged.count() == 50
    out = education.enhance(merged)
    assert "Elementary and/or High School" not in out.columns
    rows = {(r.GEO, r.REF_DATE.year): r for r in out.collect()}
    odd = rows["Ontario", 1987]
    assert odd["Total operating expenditures"] == 1020.0
    assert odd["OpSpend_per_Educator"] == 10.0 and odd["Education_Access_Index"] == 20.0
    assert rows["Quebec", 1987]["College"] == 10.0
    assert rows["Ontario", 1990]["Teachers salaries"] == 0.0
    assert education.enhance(merged, zeros_as_null=True).where("`Teachers salaries` is null").count() == 2
    ahead = education.education_forecast(out)
    assert ahead.count() == 2 * 16
    assert ahead.where("`Total, work status` <= 0").count() == 0
    year = ahead.where("GEO = 'Ontario' and year(REF_DATE) = 2020").first()
    assert year["Total, work status"] == pytest.approx(135.0, rel=0.1)


def test_pipeline_runs_what_it_has_inputs_for(spark, tmp_path, sheets):
    raw = tmp_path
    months = pd.date_range("2015-01-01", "2023-12-01", freq="MS")
    geos = ["New Brunswick", "Prince Edward Island", "Canada"]
    starts = [f"{t:%Y-%m},{g},{k},Total units,{30 + t.month}" for t in months if t.month in (1, 4, 7, 10) for g in geos
              for k in ("Housing starts", "Housing completions", "Housing under construction")]
    (raw / "HousingStarted_Raw.csv").write_text("REF_DATE,GEO,Housing estimates,Type of unit,VALUE\n" + "\n".join(starts))
    prices = [f"{t:%b-%y},{g},{k},{100 + t.month}" for t in months for g in geos for k in ("House only", "Land only", "Total (house and land)")]
    (raw / "NHPI.csv").write_text("REF_DATE,GEO,New housing price indexes,VALUE\n" + "\n".join(prices))
    report = pipeline.run_all(spark, str(raw), str(tmp_path / "out"), trees=2)
    status = {r.output: r.status for r in report.collect()}
    made = {k for k, v in status.items() if v == "generated"}
    assert made == {"households", "housing_starts", "price_index", "housing_features", "housing_engineered",
                    "housing_metrics", "housing_forecast"}
    assert set(status) == set(pipeline.OUTPUTS)


def test_regions_are_complete():
    assert len(REGIONS) == len(set(REGIONS)) == 11


def test_pipeline_runs_population_and_education(spark, tmp_path):
    """All branches but housing, from raw files to forecasts; one folder holds a broken file."""
    raw, years, geos = tmp_path, range(1990, 2012), ["Ontario", "Quebec"]

    def put(name, header, rows):
        path = raw / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join([header, *(",".join(f'"{v}"' for v in r) for r in rows)]) + "\n")

    flows = ["Total PRs", "Total TRs", "Total Births", "Total Deaths", "Population Estimate"]
    put(pipeline.POPULATION, ",".join(["Year", "Province", *flows]), [(y, g, 10, 5, 8, 4, 1000 + y) for y in years for g in geos])
    put(pipeline.OFFICIAL, ",".join(["Year", "Province", *flows]), [(y, "Canada", 1, 1, 1, 1, 9000 + y) for y in years])
    for name, regions in zip(pipeline.AGES, (geos, ["Canada"])):
        put(name, "REF_DATE,GEO,Gender,Age group,VALUE",
            [(y, g, s, a, 100) for y in years for g in regions for s in ("Men+", "Women+") for a in ("All ages", "0 to 14 years")])
    put(pipeline.EDUCATION["educators"], "REF_DATE,GEO,Work status,VALUE",
        [(f"{y}/{y + 1}", g, s, 100 + y) for y in years for g in geos for s in education.WORK_STATUS])
    put(pipeline.EDUCATION["education_prices"], "REF_DATE,GEO,Index categories,VALUE",
        [(y, g, c, y - 1900) for y in years for g in geos for c in education.PRICE_CATEGORIES])
    put(pipeline.EDUCATION["expenditures"], "REF_DATE,GEO,Type of expenditure,VALUE",
        [(f"{y}/{y + 1}", g, c, 5000 + y if y % 3 else "..") for y in years for g in geos for c in education.EXPENDITURES])
    put(pipeline.EDUCATION["graduation_rates"] + "/a.csv", "REF_DATE,GEO,Gender,Graduation rate,VALUE",
        [(f"{y}/{y + 1}", "Ontario", "Total gender", c, 80) for y in years for c in education.GRADUATION])
    put(pipeline.EDUCATION["graduation_rates"] + "/b.csv", "GEO,REF_DATE,Graduation rate,Gender,VALUE",
        [("Quebec", f"{y}/{y + 1}", c, g, 70) for y in years for c in education.GRADUATION for g in ("Total gender", "Men")])
    (raw / pipeline.EDUCATION["graduation_rates"] / "c.csv.gz").write_bytes(b"no gzip at all")
    put(pipeline.EDUCATION["participation_rates"] + "/a.csv", f"REF_DATE,GEO,{education.PARTICIPATION_DIMENSIONS[0]},VALUE",
        [(f"{y}/{y + 1}", g, c, 30) for y in years for g in geos for c in [*education.INSTITUTIONS, "Total participation rate"]])
    out = str(tmp_path / "out")
    report = {r.output: (r.status, r.rows) for r in pipeline.run_all(spark, str(raw), out, trees=2, fmt="csv").collect()}
    made = {k for k, (status, _) in report.items() if status == "generated"}
    wanted = {"demographics", "population_metrics", *pipeline.EDUCATION, "missing_regions", "education_features", "missing_values",
              "education_enhanced", "education_forecast"}
    assert made == wanted
    people = spark.read.parquet(f"{out}/demographics")
    national = people.where("Province = 'Canada' and Year = 2000 and Age_Group_Category = 'All Ages'").first()
    assert (national["Total PRs"], national["Population Estimate"], national["Combined_Population"]) == (20.0, 11000.0, 200.0)
    assert report["graduation_rates"][1] == 2 * len(years) == report["education_enhanced"][1]
    missing = {r["column"]: r["missing"] for r in spark.read.parquet(f"{out}/missing_values").collect()}
    assert missing == {} or all(v < len(years) for v in missing.values())
    forecast = spark.read.parquet(f"{out}/education_forecast")
    assert forecast.count() == 2 * 16 and forecast.where("`Total, work status` <= 0").count() == 0
    assert spark.read.csv(f"{out}/csv/education_enhanced", header=True).count() == 2 * len(years)
