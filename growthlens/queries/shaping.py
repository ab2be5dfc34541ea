"""Pivots, first rows, merges, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlens.operators.aggregates import keep_first
from growthlens.operators.calendars import attach_year_values
from growthlens.operators.common import with_stats
from growthlens.operators.joins import apply_aliases, fill_from_row, melt_lookup, merge_features, patch_totals
from growthlens.operators.pivots import duplicate_cells, pivot_panel
from growthlens.queries.inputs import MONTHLY, NATION_ORDERS, cents, money_sum, monthly, nation_orders, table, whole_cents
from growthlens.queries.registry import query

STATUS = {"F": "finished", "O": "open", "P": "partial"}


@query(f"""
WITH {NATION_ORDERS},
priced AS (SELECT nation, month, o_orderstatus AS s, o_orderkey AS k,
                  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS v FROM nation_orders)
SELECT nation, month,
       arg_min(v, k) FILTER (WHERE s = 'F' AND v IS NOT NULL) AS finished,
       arg_min(v, k) FILTER (WHERE s = 'O' AND v IS NOT NULL) AS open,
       arg_min(v, k) FILTER (WHERE s = 'P' AND v IS NOT NULL) AS partial
FROM priced GROUP BY nation, month""")
def pivot_first(spark, sf_dir):
    rows = nation_orders(spark, sf_dir).withColumn(
        "v", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice"))
    )
    return pivot_panel(
        rows, keys=["nation", "month"], category="o_orderstatus", values=STATUS, value="v", ordinal="o_orderkey"
    )


@query(f"""
WITH {NATION_ORDERS},
priced AS (SELECT nation, month, o_orderstatus AS s, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS v FROM nation_orders)
SELECT nation, month, AVG(v) FILTER (WHERE s = 'F') AS finished, AVG(v) FILTER (WHERE s = 'O') AS open,
       AVG(v) FILTER (WHERE s = 'P') AS partial
FROM priced GROUP BY nation, month""")
def pivot_mean(spark, sf_dir):
    """Mean price in whole cents: integer sums are exact, so no rounding is needed."""
    rows = nation_orders(spark, sf_dir).withColumn("v", whole_cents("o_totalprice"))
    return pivot_panel(
        rows, keys=["nation", "month"], category="o_orderstatus", values=STATUS, value="v", how="mean"
    )


@query(f"""
WITH {NATION_ORDERS}
SELECT nation, month,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS finished,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS open,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS partial
FROM nation_orders GROUP BY nation, month""")
def pivot_sum(spark, sf_dir):
    rows = nation_orders(spark, sf_dir).withColumn("v", cents("o_totalprice"))
    wide = pivot_panel(rows, keys=["nation", "month"], category="o_orderstatus", values=STATUS, value="v", how="sum")
    return wide.withColumns({c: F.col(c).cast("double") for c in STATUS.values()})


@query(f"""
WITH {NATION_ORDERS},
cells AS (SELECT nation, month, o_orderstatus AS s, COUNT(*) AS n FROM nation_orders GROUP BY ALL)
SELECT nation, month, MAX(n) FILTER (WHERE s = 'F') AS finished, MAX(n) FILTER (WHERE s = 'O') AS open,
       MAX(n) FILTER (WHERE s = 'P') AS partial
FROM cells GROUP BY nation, month""")
def pivot_strict(spark, sf_dir):
    cells = nation_orders(spark, sf_dir).groupBy("nation", "month", "o_orderstatus").agg(F.count("*").alias("n"))
    return pivot_panel(
        cells, keys=["nation", "month"], category="o_orderstatus", values=STATUS, value="n", how="strict"
    )


@query(f"""
WITH {NATION_ORDERS}
SELECT nation, month, o_orderstatus, COUNT(*) AS rows FROM nation_orders GROUP BY ALL HAVING COUNT(*) > 1""")
def pivot_duplicate_cells(spark, sf_dir):
    return duplicate_cells(nation_orders(spark, sf_dir), keys=["nation", "month"], category="o_orderstatus")


@query("""
SELECT o_custkey, month, o_orderkey, o_totalprice FROM (
  SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def dedupe_keep_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"), "o_orderdate", "o_orderkey",
        "o_totalprice",
    )
    first = keep_first(orders, keys=["o_custkey", "month"], order=["o_orderdate", "o_orderkey"])
    return first.drop("o_orderdate")


@query(f"""
WITH {NATION_ORDERS},
parts AS (
  SELECT CAST(year(month) AS INTEGER) AS year, nation AS region,
         COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS open,
         COUNT(DISTINCT o_custkey) AS buyers
  FROM nation_orders WHERE year(month) >= 1996 GROUP BY ALL),
official AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, COUNT(*) FILTER (WHERE l_linestatus = 'F') AS finished,
         COUNT(*) FILTER (WHERE l_linestatus = 'O') AS open, COUNT(*) AS buyers
  FROM lineitem GROUP BY ALL),
sums AS (SELECT year, CAST(SUM(finished) AS BIGINT) AS finished, CAST(SUM(open) AS BIGINT) AS open FROM parts GROUP BY year)
SELECT year, region, finished, open, buyers FROM parts
UNION ALL
SELECT o.year, 'ALL', COALESCE(s.finished, o.finished), COALESCE(s.open, o.open), o.buyers
FROM official o LEFT JOIN sums s USING (year) WHERE o.year IN (SELECT year FROM parts)""")
def total_region_patch(spark, sf_dir):
    """Totals rebuilt from the nations, the official estimate kept, years limited to the panel's."""
    rows = nation_orders(spark, sf_dir).withColumns({"year": F.year("month"), "region": F.col("nation")})
    parts = rows.where("year >= 1996").groupBy("year", "region").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_distinct("o_custkey").alias("buyers"),
    )
    official = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        F.lit("ALL").alias("region"),
        F.count_if(F.col("l_linestatus") == "F").alias("finished"),
        F.count_if(F.col("l_linestatus") == "O").alias("open"),
        F.count("*").alias("buyers"),
    )
    return patch_totals(
        parts, official, key="year", region="region", total_name="ALL", sum_cols=["finished", "open"],
        keep_cols=["buyers"],
    )


def _status_panel(spark, sf_dir, status: str, name: str):
    rows = nation_orders(spark, sf_dir).where(F.col("o_orderstatus") == status)
    return rows.groupBy("nation", "month").agg(money_sum("o_totalprice").alias(name))


_STATUS_PANELS = """
finished AS (SELECT nation, month, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS finished
             FROM nation_orders WHERE o_orderstatus = 'F' GROUP BY ALL),
opened AS (SELECT nation, month, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS open
           FROM nation_orders WHERE o_orderstatus = 'O' GROUP BY ALL),
partial AS (SELECT nation, month, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS partial
            FROM nation_orders WHERE o_orderstatus = 'P' GROUP BY ALL)"""


def _three_panels(spark, sf_dir):
    return [_status_panel(spark, sf_dir, s, n) for s, n in STATUS.items()]


@query(f"""
WITH {NATION_ORDERS}, {_STATUS_PANELS}
SELECT nation, month, finished, open, partial
FROM finished LEFT JOIN opened USING (nation, month) LEFT JOIN partial USING (nation, month)""")
def left_feature_merge(spark, sf_dir):
    return merge_features(_three_panels(spark, sf_dir), ["nation", "month"], "left")


@query(f"""
WITH {NATION_ORDERS}, {_STATUS_PANELS}
SELECT nation, month, finished, open, partial
FROM finished FULL JOIN opened USING (nation, month) FULL JOIN partial USING (nation, month)""")
def outer_merge_n(spark, sf_dir):
    return merge_features(_three_panels(spark, sf_dir), ["nation", "month"], "full")


@query(f"""
WITH {NATION_ORDERS}, {_STATUS_PANELS}
SELECT nation, month, finished, open, partial
FROM finished JOIN opened USING (nation, month) JOIN partial USING (nation, month)""")
def inner_merge_n(spark, sf_dir):
    return merge_features(_three_panels(spark, sf_dir), ["nation", "month"], "inner")


@query(f"""
WITH {NATION_ORDERS}, {_STATUS_PANELS}
SELECT nation, month, f.finished AS revenue, o.open AS revenue_dup1, p.partial AS revenue_dup2
FROM finished f FULL JOIN opened o USING (nation, month) FULL JOIN partial p USING (nation, month)""")
def outer_suffix_merge(spark, sf_dir):
    panels = [_status_panel(spark, sf_dir, s, "revenue") for s in STATUS]
    return merge_features(panels, ["nation", "month"], "full", on_clash="suffix")


@query(f"""
WITH {NATION_ORDERS}, {_STATUS_PANELS}
SELECT nation, month, COALESCE(f.finished, o.open, p.partial) AS revenue
FROM finished f FULL JOIN opened o USING (nation, month) FULL JOIN partial p USING (nation, month)""")
def outer_coalesce_merge(spark, sf_dir):
    panels = [_status_panel(spark, sf_dir, s, "revenue") for s in STATUS]
    return merge_features(panels, ["nation", "month"], "full", on_clash="coalesce")


@query("""
WITH yearly AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS p, COUNT(*) AS n FROM orders GROUP BY ALL),
base AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, COUNT(*) AS lines FROM lineitem GROUP BY ALL)
SELECT b.year, b.lines, u.n AS urgent, h.n AS high, l.n AS low
FROM base b LEFT JOIN yearly u ON u.year = b.year AND u.p = '1-URGENT'
LEFT JOIN yearly h ON h.year = b.year AND h.p = '2-HIGH' LEFT JOIN yearly l ON l.year = b.year AND l.p = '5-LOW'""")
def year_left_chain(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    tables = [
        table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("lines"))
    ]
    for value, name in {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}.items():
        rows = orders.where(F.col("o_orderpriority") == value)
        tables.append(rows.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias(name)))
    return merge_features(tables, ["year"], "left")


@query(f"""
WITH {NATION_ORDERS},
wide AS (
  SELECT CAST(year(month) AS INTEGER) AS year,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS F,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS O,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS P
  FROM nation_orders GROUP BY ALL),
long AS (UNPIVOT wide ON F, O, P INTO NAME status VALUE total)
SELECT nation, CAST(year(month) AS INTEGER) AS year, o_orderstatus AS status, COUNT(*) AS n, MAX(total) AS total
FROM nation_orders LEFT JOIN long ON long.year = year(month) AND long.status = o_orderstatus GROUP BY 1, 2, 3""")
def wide_lookup(spark, sf_dir):
    """Each (nation, year, status) cell looks its status total up in a table with one column per status."""
    rows = nation_orders(spark, sf_dir).withColumns({"year": F.year("month"), "status": F.col("o_orderstatus")})
    wide = pivot_panel(
        rows.withColumn("v", cents("o_totalprice")), keys=["year"], category="status", values=list(STATUS), value="v",
        how="sum",
    ).select("year", *[F.col(s).cast("double").alias(s) for s in STATUS])
    cells = rows.groupBy("nation", "year", "status").agg(F.count("*").alias("n"))
    return melt_lookup(cells, wide, id="year", name_col="status", value_col="total")


@query(f"""
WITH {NATION_ORDERS},
cells AS (
  SELECT nation, CAST(year(month) AS INTEGER) AS year, o_orderpriority AS priority,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN MAX(o_totalprice) END AS top
  FROM nation_orders GROUP BY 1, 2, 3)
SELECT nation, year, priority,
       COALESCE(top, MAX(CASE WHEN priority = '1-URGENT' THEN top END) OVER (PARTITION BY nation, year)) AS top
FROM cells""")
def fill_from_reference_row(spark, sf_dir):
    rows = nation_orders(spark, sf_dir).withColumns({"year": F.year("month"), "priority": F.col("o_orderpriority")})
    cells = rows.groupBy("nation", "year", "priority").agg(F.max("o_totalprice").alias("top"))
    cells = cells.withColumn("top", F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), F.col("top")))
    return fill_from_row(cells, keys=["nation", "year"], flag=F.col("priority") == "1-URGENT", cols=["top"])


SEGMENT_NAMES = {"BUILDING": "Construction", "FURNITURE": "Home", "HOUSEHOLD": "Home", "MACHINERY": "Industry"}


@query(f"""
WITH {NATION_ORDERS},
names(alias, name) AS (VALUES ('BUILDING', 'Construction'), ('FURNITURE', 'Home'), ('HOUSEHOLD', 'Home'), ('MACHINERY', 'Industry'))
SELECT name AS segment, nation, COUNT(*) AS n_orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM nation_orders JOIN names ON alias = trim(c_mktsegment) GROUP BY ALL""")
def alias_map(spark, sf_dir):
    rows = apply_aliases(nation_orders(spark, sf_dir), "c_mktsegment", SEGMENT_NAMES, out="segment")
    return rows.groupBy("segment", "nation").agg(
        F.count("*").alias("n_orders"), money_sum("o_totalprice").alias("revenue")
    )


@query(f"""
WITH {NATION_ORDERS}
SELECT r.r_name AS region, COUNT(*) AS n_orders FROM nation_orders o JOIN (
  SELECT n_name AS alias, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) r ON r.alias = trim(o.nation)
GROUP BY ALL""")
def alias_table(spark, sf_dir):
    """Aliases held in a table rather than a dict."""
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    names = table(spark, sf_dir, "nation").join(region, "n_regionkey").select("n_name", "r_name")
    counts = nation_orders(spark, sf_dir).groupBy("nation").agg(F.count("*").alias("n"))
    rows = apply_aliases(counts, "nation", names, out="region")
    return rows.groupBy("region").agg(F.sum("n").alias("n_orders"))


@query(f"""
WITH {MONTHLY},
yearly AS (SELECT nation, CAST(year(month) AS INTEGER) AS year, CAST(SUM(n_orders) AS BIGINT) AS year_orders FROM monthly GROUP BY ALL)
SELECT m.nation, m.month, m.n_orders, y.year_orders,
       CAST(SUM(m.n_orders) OVER (PARTITION BY m.month) AS BIGINT) AS month_orders
FROM monthly m LEFT JOIN yearly y ON y.nation = m.nation AND y.year = year(m.month)""")
def attach_totals(spark, sf_dir):
    """Yearly totals and totals over all nations joined onto the monthly rows."""
    rows = monthly(spark, sf_dir).drop("revenue")
    yearly = rows.groupBy("nation", F.year("month").alias("year")).agg(F.sum("n_orders").alias("year_orders"))
    out = attach_year_values(rows, yearly, keys=["nation"], time="month", year="year")
    return with_stats(out, ["month"], {"month_orders": F.sum("n_orders")})
