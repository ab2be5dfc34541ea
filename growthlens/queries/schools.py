"""The education jobs: orders take the place of the published tables, nations that of regions, statuses and priorities
that of categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlens.operators.common import q
from growthlens.operators.stats import null_report
from growthlens.plans import education
from growthlens.plans.regions import REGIONS
from growthlens.queries.inputs import NATION_ORDERS, interpolation_sql, nation_orders, round_cols
from growthlens.queries.registry import query

_STATUS, _PRIORITY = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


def _published(spark, sf_dir, category: str, by: str, names: dict[str, str], missing: str):
    """REF_DATE, GEO, the category column and VALUE as text, `..` where missing; two nations have no region."""
    rows = nation_orders(spark, sf_dir)
    number = F.substring("nation", 8, 10).cast("int")
    cases = [F.when(F.col(by) == k, F.lit(v)) for k, v in names.items()]
    return rows.select(
        F.year("month").cast("string").alias("REF_DATE"),
        F.coalesce(F.get(F.array(*[F.lit(r) for r in REGIONS]), F.pmod(number, F.lit(13))), F.lit("Elsewhere")).alias("GEO"),
        F.coalesce(*cases, F.lit("Other")).alias(category),
        F.when(F.expr(missing), "..").otherwise(F.col("o_totalprice").cast("string")).alias("VALUE"),
        "o_orderkey", "c_mktsegment",
    )


_REGIONS = "[" + ", ".join(f"'{r}'" for r in REGIONS) + "]"


def _wide(by: str, keys: list[str], names: list[str], missing: str, *, grid: str = "TRUE") -> str:
    """CTE wide(y, region, one column per name): the first known value of each cell by order key."""
    cells = ", ".join(f"arg_min(v, k) FILTER (WHERE cat = '{k}' AND v IS NOT NULL) AS {n}" for k, n in zip(keys, names))
    return f"""{NATION_ORDERS},
published AS (
  SELECT year(month) AS y, {_REGIONS}[1 + CAST(substr(nation, 8) AS INTEGER) % 13] AS region, {by} AS cat, o_orderkey AS k,
         CASE WHEN NOT ({missing}) THEN o_totalprice END AS v, c_mktsegment
  FROM nation_orders),
wide AS (SELECT y, region, {cells} FROM published WHERE region IS NOT NULL AND {grid} GROUP BY ALL)"""


_EDUCATORS = dict(zip(_STATUS, education.WORK_STATUS))
_PRICES = dict(zip(_PRIORITY, education.PRICE_CATEGORIES))
_SPENT = dict(zip(_PRIORITY, education.EXPENDITURES))
_NONE = "o_orderpriority = '4-NOT SPECIFIED'"


def _educators(spark, sf_dir):
    return education.educators(_published(spark, sf_dir, "Work status", "o_orderstatus", _EDUCATORS, _NONE), ordinal=["o_orderkey"])


def _prices(spark, sf_dir):
    raw = _published(spark, sf_dir, "Index categories", "o_orderpriority", _PRICES, "o_orderstatus = 'P'")
    return education.education_prices(raw, ordinal=["o_orderkey"])


@query(f"""
WITH {_wide("o_orderstatus", _STATUS, ["full_time", "part_time", "total"], _NONE)}
SELECT CAST(y AS INTEGER) AS year, region, full_time, part_time, total FROM wide""")
def educators_job(spark, sf_dir):
    out = _educators(spark, sf_dir)
    return out.select(
        q("REF_DATE").alias("year"), q("GEO").alias("region"), *[q(c).alias(n) for c, n in zip(education.WORK_STATUS, ("full_time", "part_time", "total"))]
    )


_FIRST_PRICES = list(_PRICES.values())


@query(f"""
WITH {_wide("o_orderpriority", _PRIORITY[: len(_FIRST_PRICES)], [f"c{i}" for i in range(len(_FIRST_PRICES))], "o_orderstatus = 'P'")}
SELECT CAST(y AS INTEGER) AS year, region, {", ".join(f"c{i}" for i in range(len(_FIRST_PRICES)))} FROM wide""")
def education_prices_job(spark, sf_dir):
    """Categories without any row are columns without values; those that have rows are compared."""
    out = _prices(spark, sf_dir)
    return out.select(q("REF_DATE").alias("year"), q("GEO").alias("region"), *[q(c).alias(f"c{i}") for i, c in enumerate(_FIRST_PRICES)])


_LISTED = "cat <> '4-NOT SPECIFIED'"
_SPENT_NAMES = ["dropped", "salaries", "whole", "running"]


@query(f"""
WITH {_wide("o_orderpriority", _PRIORITY, _SPENT_NAMES, "o_orderstatus = 'P'", grid=_LISTED)},
{interpolation_sql("wide", "region", "y", "salaries")}
SELECT CAST(y AS INTEGER) AS year, region, ROUND(value, 4) AS salaries, 5 AS n_columns FROM filled""")
def expenditures_job(spark, sf_dir):
    """Gaps interpolated within the region; one of the four categories is dropped at the end."""
    raw = _published(spark, sf_dir, "Type of expenditure", "o_orderpriority", _SPENT, "o_orderstatus = 'P'")
    out = education.expenditures(raw, ordinal=["o_orderkey"])
    salaries = q("Teachers salaries").alias("salaries")
    return round_cols(out.select(q("REF_DATE").alias("year"), q("GEO").alias("region"), salaries, F.lit(len(out.columns)).alias("n_columns")), ["salaries"], 4)


@query(f"""
WITH {_wide("o_orderstatus", ["O", "F"], ["extended", "on_time"], _NONE, grid="c_mktsegment = 'BUILDING'")},
{interpolation_sql("wide", "region", "y", "on_time")}
SELECT CAST(y AS INTEGER) AS year, region, ROUND(value, 4) AS on_time FROM filled""")
def graduation_rates_job(spark, sf_dir):
    """Rows of all genders together; a market segment plays that part."""
    raw = _published(spark, sf_dir, "Graduation rate", "o_orderstatus", {"F": "On-time", "O": "Extended-time"}, _NONE)
    raw = raw.withColumn("Gender", F.when(F.col("c_mktsegment") == "BUILDING", "Total gender").otherwise("Men"))
    out = education.graduation_rates(raw, ordinal=["o_orderkey"])
    return round_cols(out.select(q("REF_DATE").alias("year"), q("GEO").alias("region"), q("On-time").alias("on_time")), ["on_time"], 4)


@query(f"""
WITH {_wide("o_orderstatus", _STATUS, ["college", "school", "university"], _NONE, grid="c_mktsegment <> 'MACHINERY'")}
SELECT CAST(y AS INTEGER) AS year, region, college, school, university FROM wide""")
def participation_rates_job(spark, sf_dir):
    """The total over institutions is left out; a market segment plays that part."""
    name = education.PARTICIPATION_DIMENSIONS[1]
    raw = _published(spark, sf_dir, name, "o_orderstatus", dict(zip(_STATUS, education.INSTITUTIONS)), _NONE)
    raw = raw.withColumn(name, F.when(F.col("c_mktsegment") == "MACHINERY", "Total participation rate").otherwise(q(name)))
    out = education.participation_rates(raw, ordinal=["o_orderkey"])
    names = zip(education.INSTITUTIONS, ("college", "school", "university"))
    return out.select(q("REF_DATE").alias("year"), q("GEO").alias("region"), *[q(c).alias(n) for c, n in names])


@query(f"""
WITH {_wide("o_orderstatus", _STATUS, ["full_time", "part_time", "total"], _NONE)},
merged AS (
  SELECT CASE WHEN y < 1996 OR region <> 'Quebec' THEN full_time END AS a, CASE WHEN y < 1996 OR region <> 'Quebec' THEN part_time END AS b,
         CASE WHEN y > 1992 THEN total END AS c FROM wide WHERE y < 1996 OR region <> 'Quebec' OR y > 1992),
counts AS (
  SELECT 'Full-time educators' AS name, COUNT(*) AS n, COUNT(*) - COUNT(a) AS missing FROM merged
  UNION ALL SELECT 'Part-time educators', COUNT(*), COUNT(*) - COUNT(b) FROM merged
  UNION ALL SELECT 'Total, work status', COUNT(*), COUNT(*) - COUNT(c) FROM merged)
SELECT name AS "column", missing, ROUND(missing * 100.0 / n, 6) AS missing_pct FROM counts WHERE missing > 0""")
def missing_values_report(spark, sf_dir):
    """What the outer merge of two tables misses, column by column: each lacks rows that the other has."""
    whole = _educators(spark, sf_dir)
    left = whole.where((q("REF_DATE") < 1996) | (q("GEO") != "Quebec")).select("REF_DATE", "GEO", q("Full-time educators"), q("Part-time educators"))
    right = whole.where(q("REF_DATE") > 1992).select("REF_DATE", "GEO", q("Total, work status"))
    return round_cols(null_report(education.education_features([left, right])), ["missing_pct"], 6)
