"""The domain jobs on driver tables that take the place of the published statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlens.operators.common import q
from growthlens.operators.series import interpolate
from growthlens.plans import education, exploration, housing, population
from growthlens.queries.inputs import (
    MONTHLY,
    NATION_ORDERS,
    interpolation_sql,
    monthly,
    nation_orders,
    quarterly,
    round_cols,
    table,
)
from growthlens.queries.registry import query

_AGES = {
    "1-URGENT": "0 to 14 years",
    "2-HIGH": "15 to 64 years",
    "3-MEDIUM": "90 years and older",
    "4-NOT SPECIFIED": "65 to 89 years",
    "5-LOW": "All ages",
}


def _choose(col: str, mapping: dict[str, str]):
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out


def _count(cond):
    return F.count_if(cond).cast("double")


@query(f"""
WITH {NATION_ORDERS},
ts AS (
  SELECT year(month) AS y, nation, o_orderpriority AS p, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS prs,
         COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS trs, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS births,
         COUNT(*) FILTER (WHERE o_totalprice > 300000) AS deaths, COUNT(*) AS est
  FROM nation_orders GROUP BY ALL),
first AS (SELECT * FROM ts QUALIFY row_number() OVER (PARTITION BY y, nation ORDER BY p) = 1),
official AS (SELECT year(l_shipdate) AS y, COUNT(*) AS n FROM lineitem GROUP BY 1),
sums AS (SELECT y, SUM(prs) AS prs, SUM(trs) AS trs, SUM(births) AS births, SUM(deaths) AS deaths FROM first GROUP BY 1),
totals AS (
  SELECT y, nation AS province, prs, trs, births, deaths, est FROM first
  UNION ALL SELECT o.y, 'Canada', COALESCE(s.prs, n), COALESCE(s.trs, n), COALESCE(s.births, n), COALESCE(s.deaths, n), n
  FROM official o LEFT JOIN sums s USING (y) WHERE o.y IN (SELECT y FROM first)),
ages AS (
  SELECT year(month) AS y, nation AS province, o_orderpriority AS p, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS m,
         COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS f FROM nation_orders GROUP BY ALL
  UNION ALL
  SELECT year(month), 'Canada', o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F'),
         COUNT(*) FILTER (WHERE o_orderstatus = 'O') FROM nation_orders GROUP BY ALL),
names(p, category) AS (VALUES ('1-URGENT', 'Children (0–14)'), ('2-HIGH', 'Working Age (15–64)'),
                              ('3-MEDIUM', 'Elderly (90+)'), ('5-LOW', 'All Ages'))
SELECT make_date(a.y, 1, 1) AS ref_date, CAST(a.y AS INTEGER) AS year, a.province, category, CAST(m AS DOUBLE) AS male,
       CAST(f AS DOUBLE) AS female, CASE WHEN m > 0 AND f > 0 THEN CAST(m + f AS DOUBLE) ELSE 0 END AS combined,
       CAST(prs AS DOUBLE) AS prs, CAST(trs AS DOUBLE) AS trs, CAST(births AS DOUBLE) AS births,
       CAST(deaths AS DOUBLE) AS deaths, CAST(est AS DOUBLE) AS estimate,
       ROUND((prs - trs) * 1000.0 / est, 6) AS migration_rate, ROUND((prs - trs + births - deaths) * 100.0 / est, 6) AS growth_pct
FROM ages a JOIN names USING (p) LEFT JOIN totals t ON t.y = a.y AND t.province = a.province WHERE m + f > 0""")
def demographics_job(spark, sf_dir):
    """Priorities play the age groups, statuses the genders; several rows per (year, nation) exercise the dedupe."""
    c = F.col
    rows = nation_orders(spark, sf_dir).withColumns({"Year": F.year("month"), "Province": F.concat(F.lit(" "), "nation")})
    timeseries = rows.groupBy("Year", "Province", "o_orderpriority").agg(
        _count(c("o_orderstatus") == "F").alias("Total PRs"),
        _count(c("o_orderstatus") == "O").alias("Total TRs"),
        _count(c("o_orderstatus") == "P").alias("Total Births"),
        _count(c("o_totalprice") > 300000).alias("Total Deaths"),
        F.count("*").alias("Population Estimate"),
    )
    official = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("Year")).agg(
        F.lit("Canada").alias("Province"),
        *[F.count("*").alias(n) for n in ("Total PRs", "Total TRs", "Total Births", "Total Deaths", "Population Estimate")],
    )
    people = rows.withColumns(
        {"Age group": _choose("o_orderpriority", _AGES), "Gender": _choose("o_orderstatus", {"F": "Men+", "O": "Women+", "P": "Total"})}
    )
    ages = people.groupBy("Year", "Province", "Gender", "Age group").agg(F.count("*").cast("string").alias("VALUE"))
    national = people.groupBy("Year", "Gender", "Age group").agg(F.count("*").cast("string").alias("VALUE"))
    ages, national = ages.withColumnsRenamed({"Year": "REF_DATE", "Province": "GEO"}), national.withColumnRenamed("Year", "REF_DATE")
    out = population.demographics(
        timeseries, official, ages, national.withColumn("GEO", F.lit("Canada")), ordinal=["o_orderpriority"]
    )
    out = population.population_metrics(out)
    return out.select(
        c("REF_DATE").alias("ref_date"), c("Year").alias("year"), c("Province").alias("province"),
        c("Age_Group_Category").alias("category"), c("Male_Population").alias("male"),
        c("Female_Population").alias("female"), c("Combined_Population").alias("combined"), c("Total PRs").alias("prs"),
        c("Total TRs").alias("trs"), c("Total Births").alias("births"), c("Total Deaths").alias("deaths"),
        c("Population Estimate").alias("estimate"), F.round("Net Migration Rate", 6).alias("migration_rate"),
        F.round(q("Population Growth Rate (%)"), 6).alias("growth_pct"),
    )


@query(f"""
WITH {NATION_ORDERS},
raw AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS month, nation, o_orderstatus AS s, o_totalprice AS v,
               o_orderkey AS k FROM nation_orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),
wide AS (SELECT month, nation, arg_min(v, k) FILTER (WHERE s = 'F') AS completions, arg_min(v, k) FILTER (WHERE s = 'O') AS starts,
                arg_min(v, k) FILTER (WHERE s = 'P') AS under_construction FROM raw GROUP BY ALL),
spine AS (SELECT r.nation, CAST(g.m AS DATE) AS month FROM (SELECT DISTINCT nation FROM wide) r,
          (SELECT unnest(generate_series((SELECT MIN(month) FROM raw), (SELECT MAX(month) FROM raw), INTERVAL 1 MONTH)) AS m) g)
SELECT s.month, s.nation, ROUND(COALESCE(w.completions, 0) / 3, 4) AS completions, ROUND(COALESCE(w.starts, 0) / 3, 4) AS starts,
       ROUND(COALESCE(w.under_construction, 0) / 3, 4) AS under_construction
FROM spine s LEFT JOIN wide w ON w.nation = s.nation AND w.month = CAST(date_trunc('quarter', s.month) AS DATE)
WHERE s.month >= DATE '1976-01-01' AND s.month <= (SELECT MAX(month) FROM raw)""")
def housing_starts_job(spark, sf_dir):
    rows = nation_orders(spark, sf_dir)
    raw = rows.select(
        F.date_format(F.trunc("month", "quarter"), "yyyy-MM").alias("REF_DATE"),
        F.col("nation").alias("GEO"),
        _choose("o_orderstatus", {"F": "Housing completions", "O": "Housing starts", "P": "Housing under construction"}).alias(
            "Housing estimates"
        ),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "Total units").otherwise("Single").alias("Type of unit"),
        F.col("o_totalprice").cast("string").alias("VALUE"),
        "o_orderkey",
    )
    out = housing.housing_starts(raw, ordinal=["o_orderkey"], regions=None)
    names = {"Housing completions": "completions", "Housing starts": "starts", "Housing under construction": "under_construction"}
    out = out.withColumnsRenamed({**names, "REF_DATE": "month", "GEO": "nation"})
    return round_cols(out, names.values(), 4)


@query(f"""
WITH {NATION_ORDERS}
SELECT month, nation, CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS house,
       CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS land, CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS total
FROM nation_orders GROUP BY month, nation""")
def price_index_job(spark, sf_dir):
    cells = nation_orders(spark, sf_dir).groupBy("month", "nation", "o_orderstatus").agg(F.count("*").alias("n"))
    raw = cells.select(
        F.date_format("month", "MMM-yy").alias("REF_DATE"),
        F.col("nation").alias("GEO"),
        _choose("o_orderstatus", {"F": "House only", "O": "Land only", "P": "Total (house and land)"}).alias(
            "New housing price indexes"
        ),
        F.col("n").cast("string").alias("VALUE"),
    )
    out = housing.price_index(raw, regions=None)
    names = {"House only NHPI": "house", "Land only NHPI": "land", "Total (house and land) NHPI": "total"}
    return out.withColumnsRenamed({**names, "REF_DATE": "month", "GEO": "nation"}).fillna(0, subset=list(names.values()))


@query(f"""
WITH {NATION_ORDERS},
sheet AS (SELECT nation, year(month) AS y, COUNT(DISTINCT o_custkey) / 10.0 AS v FROM nation_orders GROUP BY 1, 2),
dense AS (SELECT r.nation, CAST(g.y AS INTEGER) AS y, s.v FROM (SELECT DISTINCT nation FROM sheet) r
          CROSS JOIN (SELECT unnest(generate_series((SELECT MIN(y) FROM sheet), 2036)) AS y) g
          LEFT JOIN sheet s ON s.nation = r.nation AND s.y = g.y),
{interpolation_sql("dense", "nation", "y", "v")},
yearly AS (SELECT nation, y, CAST(round_even(CAST(COALESCE(value, 0) AS DOUBLE), 0) AS BIGINT) * 1000 AS households FROM filled),
named AS (SELECT n.r_name || '/' || nation AS geo, y, households FROM yearly
           JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) n ON n_name = nation
         UNION ALL SELECT 'Canada', y, CAST(SUM(households) AS BIGINT) FROM yearly GROUP BY y)
SELECT geo, CAST(make_date(y, 1, 1) + to_months(CAST(k AS INTEGER)) AS DATE) AS month, households FROM named, range(12) t(k)""")
def households_job(spark, sf_dir):
    """Yearly counts to a monthly series to 2036, a national sum, names from an alias table."""
    rows = nation_orders(spark, sf_dir)
    sheets = rows.groupBy(F.col("nation").alias("region"), F.year("month").alias("Year")).agg(
        (F.count_distinct("o_custkey") / 10).alias("households")
    )
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    names = table(spark, sf_dir, "nation").join(region, "n_regionkey")
    names = names.select("n_name", F.concat_ws("/", "r_name", "n_name").alias("name"))
    canada = names.agg(F.lit("Canada").alias("n_name"), F.lit("Canada").alias("name"))
    out = housing.households(sheets, aliases=names.unionByName(canada))
    return out.select(F.col("GEO").alias("geo"), F.col("REF_DATE").alias("month"), F.col("Number_of_Households").alias("households"))


@query(f"""
WITH {MONTHLY},
merged AS (SELECT nation, month, n_orders AS h,
                  CASE WHEN month(month) IN (1, 4, 7, 10) AND n_orders > 1 AND nation <> 'NATION_3' THEN revenue END AS s
           FROM monthly WHERE month >= DATE '1996-01-01' AND month <= DATE '2001-03-01'),
{interpolation_sql("merged", "nation", "month", "s")},
med AS (SELECT nation, month, h, COALESCE(value, (SELECT MEDIAN(value) FROM filled)) AS s FROM filled),
feat AS (
  SELECT nation, month, CAST(h AS DOUBLE) AS households, s AS starts, lag(h, 1) OVER w AS h1, lag(h, 3) OVER w AS h3,
         lag(h, 6) OVER w AS h6, lag(s, 1) OVER w AS s1, lag(s, 3) OVER w AS s3, lag(s, 6) OVER w AS s6,
         (h + lag(h, 1) OVER w + lag(h, 2) OVER w) / 3.0 AS hm, (s + lag(s, 1) OVER w + lag(s, 2) OVER w) / 3 AS sm
  FROM med WINDOW w AS (PARTITION BY nation ORDER BY month))
SELECT nation, month, households, ROUND(starts, 4) AS starts, CAST(h1 AS DOUBLE) AS households_lag_1,
       CAST(h6 AS DOUBLE) AS households_lag_6, ROUND(s1, 4) AS starts_lag_1, ROUND(s6, 4) AS starts_lag_6,
       ROUND(hm, 6) AS households_rolling, ROUND(sm, 4) AS starts_rolling, CAST(quarter(month) AS INTEGER) AS quarter
FROM feat WHERE h6 IS NOT NULL AND s6 IS NOT NULL""")
def housing_features_job(spark, sf_dir):
    """Feature table: trimmed, interpolated, median for the nation without data, lags, rolling means, complete rows."""
    households = monthly(spark, sf_dir).select(
        F.col("month").alias("REF_DATE"), F.col("nation").alias("GEO"), F.col("n_orders").alias("Number_of_Households")
    )
    reported = F.when(F.col("nation") != "NATION_3", F.col("revenue"))
    starts = quarterly(spark, sf_dir).select(
        F.col("month").alias("REF_DATE"), F.col("nation").alias("GEO"), reported.alias("Housing starts")
    )
    merged = housing.merge_features([households, starts], ["REF_DATE", "GEO"], "left")
    out = housing.engineer_features(merged, start="1996-01-01", end="2001-03-01")
    c = F.col
    return out.select(
        c("GEO").alias("nation"), c("REF_DATE").alias("month"), c("Number_of_Households").alias("households"),
        F.round("Housing starts", 4).alias("starts"), c("Number_of_Households_lag_1").alias("households_lag_1"),
        c("Number_of_Households_lag_6").alias("households_lag_6"), F.round("Housing starts_lag_1", 4).alias("starts_lag_1"),
        F.round("Housing starts_lag_6", 4).alias("starts_lag_6"),
        F.round("Number_of_Households_rolling_mean_3", 6).alias("households_rolling"),
        F.round("Housing starts_rolling_mean_3", 4).alias("starts_rolling"), c("Quarter").alias("quarter"),
    )


def _school_rows(spark, sf_dir):
    """Orders as a published education table: school years, categories, text values, some missing."""
    rows = nation_orders(spark, sf_dir)
    year = F.year("month")
    known = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    return rows.select(
        F.concat_ws("/", year, year + 1).alias("REF_DATE"),
        F.col("nation").alias("GEO"),
        _choose("o_orderstatus", {"F": "College", "O": "University", "P": "Total participation rate"}).alias("kind"),
        F.when(known, F.col("o_totalprice").cast("string")).otherwise("..").alias("VALUE"),
        "o_orderkey", "c_mktsegment",
    )


@query(f"""
WITH {NATION_ORDERS},
rows AS (SELECT year(month) AS y, nation, o_orderstatus AS s, o_orderkey AS k,
                CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS v
         FROM nation_orders WHERE o_orderstatus <> 'P')
SELECT CAST(y AS INTEGER) AS year, nation, arg_min(v, k) FILTER (WHERE s = 'F' AND v IS NOT NULL) AS college,
       arg_min(v, k) FILTER (WHERE s = 'O' AND v IS NOT NULL) AS university
FROM rows GROUP BY y, nation""")
def participation_job(spark, sf_dir):
    raw = education.drop_value(_school_rows(spark, sf_dir), "kind", "Total participation rate")
    out = education.category_table(raw, "kind", ["College", "University"], ordinal=["o_orderkey"], regions=None)
    return out.withColumnsRenamed({"REF_DATE": "year", "GEO": "nation", "College": "college", "University": "university"})


_SCHOOL = f"""{NATION_ORDERS},
rows AS (SELECT year(month) AS y, nation, o_orderstatus AS s, o_orderkey AS k, c_mktsegment AS seg, o_totalprice AS v
         FROM nation_orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),
wide AS (
  SELECT y, nation, arg_min(v, k) FILTER (WHERE s = 'F' AND y NOT IN (1997, 1998)) AS college,
         arg_min(v, k) FILTER (WHERE s = 'O' AND nation <> 'NATION_5') AS university,
         arg_min(v, k) FILTER (WHERE s = 'P' AND y = 1999 AND nation = 'NATION_1') AS rare
  FROM (SELECT year(month) AS y, nation FROM nation_orders GROUP BY ALL) LEFT JOIN rows USING (y, nation) GROUP BY ALL)"""


def _school_table(spark, sf_dir):
    raw = _school_rows(spark, sf_dir)
    year = F.substring("REF_DATE", 1, 4)
    kind = (
        F.when((F.col("kind") == "College") & ~year.isin("1997", "1998"), "College")
        .when((F.col("kind") == "University") & (F.col("GEO") != "NATION_5"), "University")
        .when((F.col("kind") == "Total participation rate") & (year == "1999") & (F.col("GEO") == "NATION_1"), "Rare")
    )
    return education.category_table(
        raw.withColumn("kind", kind), "kind", ["College", "University", "Rare"], ordinal=["o_orderkey"], regions=None
    )


@query(f"""
WITH {_SCHOOL}, {interpolation_sql("wide", "nation", "y", "college")}
SELECT nation, CAST(y AS INTEGER) AS year, ROUND(value, 4) AS college FROM filled""")
def graduation_job(spark, sf_dir):
    wide = _school_table(spark, sf_dir).select("GEO", "REF_DATE", "College")
    out = interpolate(wide, keys=["GEO"], order="REF_DATE", cols=["College"])
    return round_cols(out, ["College"], 4).withColumnsRenamed({"GEO": "nation", "REF_DATE": "year", "College": "college"})


@query(f"""
WITH {_SCHOOL}, {interpolation_sql("wide", "nation", "y", "college")},
c AS (SELECT nation, y, COALESCE(value, AVG(value) OVER (PARTITION BY nation)) AS college FROM filled),
c2 AS (SELECT nation, y, COALESCE(college, (SELECT AVG(college) FROM c)) AS college FROM c),
un AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY y) AS n2 FROM wide),
uk AS (
  SELECT *, last_value(CASE WHEN university IS NOT NULL THEN n2 END IGNORE NULLS) OVER up AS pn2,
         last_value(university IGNORE NULLS) OVER up AS pv2,
         first_value(CASE WHEN university IS NOT NULL THEN n2 END IGNORE NULLS) OVER down AS nn2,
         first_value(university IGNORE NULLS) OVER down AS nv2
  FROM un WINDOW up AS (PARTITION BY nation ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 down AS (PARTITION BY nation ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (SELECT nation, y, COALESCE(university, pv2 + (nv2 - pv2) * (n2 - pn2) / (nn2 - pn2), pv2) AS university FROM uk),
u1 AS (SELECT nation, y, COALESCE(university, AVG(university) OVER (PARTITION BY nation)) AS university FROM u),
u2 AS (SELECT nation, y, COALESCE(university, (SELECT AVG(university) FROM u1)) AS university FROM u1)
SELECT nation, make_date(y, 1, 1) AS ref_date, ROUND(college, 3) AS college, ROUND(university, 3) AS university,
       ROUND((college + university) / 2, 3) AS access_index
FROM c2 JOIN u2 USING (nation, y)""")
def education_enhance_job(spark, sf_dir):
    """A nearly empty column is dropped, gaps are interpolated, a nation without data takes the overall mean."""
    merged = education.education_features(
        [
            _school_table(spark, sf_dir).select("REF_DATE", "GEO", "College", "Rare"),
            _school_table(spark, sf_dir).select("REF_DATE", "GEO", "University"),
        ]
    )
    out = education.enhance(merged)
    c = F.col
    return out.select(
        c("GEO").alias("nation"), c("REF_DATE").alias("ref_date"), F.round("College", 3).alias("college"),
        F.round("University", 3).alias("university"), F.round("Education_Access_Index", 3).alias("access_index"),
    )


@query()
def education_forecast_job(spark, sf_dir):
    """Upsampled to months, screened, fitted per (column, nation), kept positive, 2020 to 2035."""
    merged = education.education_features([_school_table(spark, sf_dir).drop("Rare")])
    out = education.education_forecast(merged)
    out = round_cols(out, ["College", "University"], 3)
    return out.withColumnsRenamed({"GEO": "nation", "REF_DATE": "ref_date", "College": "college", "University": "university"})


@query()
def compare_models_job(spark, sf_dir):
    """Mean absolute error of three models on the last 30 months of the sum over all nations."""
    total = monthly(spark, sf_dir).groupBy(F.col("month").alias("REF_DATE")).agg(
        F.lit("Canada").alias("GEO"), F.sum("n_orders").alias("Number_of_Households")
    )
    return round_cols(exploration.compare_models(total), ["mae"], 6)
