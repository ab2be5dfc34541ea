"""Filling, outlier screens, profiles, correlations, row-wise features, text and date functions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from growthlens.functions import (
    half_even,
    iso_text,
    mapped,
    month_year,
    plain_number,
    ratio,
    row_mean,
    row_sum,
    safe_rate,
    to_number,
    year_of,
    year_start,
)
from growthlens.operators import sketches, stats
from growthlens.operators.aggregates import rollup
from growthlens.operators.aggregates import supply_demand as demand_against_supply
from growthlens.operators.common import join_back
from growthlens.operators.fills import fill_constant, fill_group_stat, fill_means, fill_median as fill_with_median, repair
from growthlens.operators.project import (
    complete_rows,
    drop_sparse as drop_sparse_columns,
    drop_value,
    every_nth,
    keep_range,
    keep_values,
    numeric_cols,
    require,
    scale,
    zeros_to_null,
)
from growthlens.queries.inputs import (
    MONTHLY,
    NATION_ORDERS,
    QUARTERLY,
    money_sum,
    monthly,
    nation_orders,
    quarterly,
    round_cols,
    table,
    whole_cents,
)
from growthlens.queries.registry import query
from growthlens.session import materialised


@query(f"""
WITH {QUARTERLY},
sparse AS (SELECT nation, month, CASE WHEN n_orders > 2 AND nation <> 'NATION_3' THEN n_orders END AS n_orders FROM quarterly),
grouped AS (SELECT nation, month, COALESCE(n_orders, AVG(n_orders) OVER (PARTITION BY nation)) AS v FROM sparse)
SELECT nation, month, ROUND(COALESCE(v, (SELECT AVG(v) FROM grouped)), 6) AS n_orders FROM grouped""")
def fill_group_overall_mean(spark, sf_dir):
    """One nation has no value at all and takes the overall mean."""
    known = (F.col("n_orders") > 2) & (F.col("nation") != "NATION_3")
    panel = quarterly(spark, sf_dir).select("nation", "month", F.when(known, F.col("n_orders")).alias("n_orders"))
    return round_cols(fill_means(panel, keys=["nation"], cols=["n_orders"]), ["n_orders"], 6)


@query(f"""
WITH {QUARTERLY}
SELECT nation, month, COALESCE(revenue, (SELECT MEDIAN(revenue) FROM quarterly)) AS revenue FROM quarterly""")
def fill_median(spark, sf_dir):
    return fill_with_median(quarterly(spark, sf_dir).select("nation", "month", "revenue"), ["revenue"])


@query(f"""
WITH {QUARTERLY}
SELECT nation, month, COALESCE(revenue, MAX(revenue) OVER (PARTITION BY nation)) AS top, COALESCE(revenue, 0) AS zero
FROM quarterly""")
def fill_group_and_constant(spark, sf_dir):
    panel = quarterly(spark, sf_dir).select(
        "nation", "month", F.col("revenue").alias("top"), F.col("revenue").alias("zero")
    )
    return fill_constant(fill_group_stat(panel, keys=["nation"], cols=["top"], fn="max"), ["zero"])


@query("""
WITH m AS (SELECT AVG(v) AS m, stddev_samp(v) AS d FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND((v - m) / d, 6) AS v_zscore, abs((v - m) / d) > 2 AS v_outlier
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem), m""")
def zscore_outliers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", whole_cents("l_extendedprice").alias("v")
    )
    return round_cols(stats.zscore(lines, ["v"], threshold=2.0), ["v_zscore"], 6).drop("v")


@query("""
WITH v AS (SELECT event_type, event_id, value FROM events),
m AS (SELECT event_type, AVG(value) AS m, stddev_samp(value) AS d FROM v GROUP BY 1)
SELECT event_id, ROUND((value - m) / d, 6) AS value_zscore, abs((value - m) / d) > 3 AS value_outlier
FROM v JOIN m USING (event_type) ORDER BY value_zscore DESC, event_id LIMIT 5""")
def top_zscores(spark, sf_dir):
    """The five largest z-scores within their event type: a report, so a limit."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    out = round_cols(stats.zscore(events, ["value"], keys=["event_type"]), ["value_zscore"], 6)
    return out.orderBy(F.desc("value_zscore"), "event_id").limit(5).drop("event_type", "value")


@query("""
WITH f AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders JOIN f USING (o_orderpriority)
WHERE o_totalprice BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""")
def iqr_filter(spark, sf_dir):
    """Five groups hold all orders: exact fences come from bracketed ranks."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return stats.iqr_filter(orders, keys=["o_orderpriority"], col="o_totalprice", k=0.5)


@query(f"""
WITH {MONTHLY},
f AS (SELECT nation, quantile_cont(n_orders, 0.25) AS q1, quantile_cont(n_orders, 0.75) AS q3 FROM monthly GROUP BY 1)
SELECT nation, month, n_orders, NOT (n_orders BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outlier
FROM monthly JOIN f USING (nation)""")
def iqr_flag_series(spark, sf_dir):
    panel = monthly(spark, sf_dir).drop("revenue")
    return stats.iqr_filter(panel, keys=["nation"], col="n_orders", action="flag", bounded=True)


@query("""
SELECT o_orderstatus, COUNT(*) AS n, ROUND(quantile_cont(o_totalprice, 0.05), 4) AS p5,
       ROUND(quantile_cont(o_totalprice, 0.25), 4) AS p25, ROUND(quantile_cont(o_totalprice, 0.5), 4) AS p50,
       ROUND(quantile_cont(o_totalprice, 0.75), 4) AS p75
FROM orders GROUP BY 1""")
def exact_quantiles(spark, sf_dir):
    names = ["p5", "p25", "p50", "p75"]
    out = stats.quantiles(
        table(spark, sf_dir, "orders"), keys=["o_orderstatus"], col="o_totalprice", probs=[0.05, 0.25, 0.5, 0.75],
        names=names,
    )
    return round_cols(out, names, 4)


@query(f"""
WITH {NATION_ORDERS}
SELECT nation, MIN(o_totalprice) AS min, ROUND(quantile_cont(o_totalprice, 0.25), 4) AS q25,
       ROUND(quantile_cont(o_totalprice, 0.5), 4) AS q50, ROUND(quantile_cont(o_totalprice, 0.75), 4) AS q75,
       MAX(o_totalprice) AS max, COUNT(*) AS n
FROM nation_orders GROUP BY 1""")
def distribution(spark, sf_dir):
    out = stats.distribution(nation_orders(spark, sf_dir), keys=["nation"], col="o_totalprice")
    return round_cols(out, ["q25", "q50", "q75"], 4)


_PROFILED = ["quantity", "price_cents", "discount_pct", "tax_pct"]


@query(
    """WITH whole AS (
  SELECT l_quantity AS quantity, round(l_extendedprice * 100) AS price_cents, round(l_discount * 100) AS discount_pct,
         round(l_tax * 100) AS tax_pct FROM lineitem)
"""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS count, AVG({c}) AS mean, ROUND(stddev_samp({c}), 5) AS std,
       MIN({c}) AS min, MAX({c}) AS max, COUNT(DISTINCT {c}) AS "distinct", ROUND(quantile_cont({c}, 0.25), 6) AS q25,
       ROUND(quantile_cont({c}, 0.5), 6) AS q50, ROUND(quantile_cont({c}, 0.75), 6) AS q75 FROM whole"""
        for c in _PROFILED
    )
)
def profile(spark, sf_dir):
    """Whole numbers throughout, so means are exact."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), whole_cents("l_extendedprice").alias("price_cents"),
        whole_cents("l_discount").alias("discount_pct"), whole_cents("l_tax").alias("tax_pct"),
    )
    return round_cols(round_cols(stats.profile(lines, _PROFILED), ["q25", "q50", "q75"], 6), ["std"], 5)


_STATUS_COUNTS = f"""{NATION_ORDERS},
wide AS (
  SELECT o_custkey, month, MAX(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS finished,
         MAX(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS open,
         MAX(o_totalprice) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS urgent_partial
  FROM nation_orders GROUP BY ALL)"""


def _sparse_wide(spark, sf_dir):
    """A wide table with one column that is missing in more than nine of ten rows."""
    rows = nation_orders(spark, sf_dir).withColumn(
        "kind",
        F.when(F.col("o_orderstatus") == "F", "finished")
        .when(F.col("o_orderstatus") == "O", "open")
        .when(F.col("o_orderpriority") == "1-URGENT", "urgent_partial"),
    )
    kinds = ("finished", "open", "urgent_partial")
    tops = [F.max(F.when(F.col("kind") == k, F.col("o_totalprice"))).alias(k) for k in kinds]
    return rows.groupBy("o_custkey", "month").agg(*tops)


@query(f"""
WITH {_STATUS_COUNTS},
c AS (SELECT COUNT(*) AS n, COUNT(*) - COUNT(finished) AS finished, COUNT(*) - COUNT(open) AS open,
             COUNT(*) - COUNT(urgent_partial) AS urgent_partial FROM wide),
long AS (UNPIVOT c ON finished, open, urgent_partial INTO NAME "column" VALUE missing)
SELECT "column", missing, ROUND(missing * 100.0 / n, 6) AS missing_pct FROM long WHERE missing > 0""")
def null_report(spark, sf_dir):
    return round_cols(stats.null_report(_sparse_wide(spark, sf_dir)), ["missing_pct"], 6)


@query(f"""
WITH {_STATUS_COUNTS}
SELECT o_custkey, month, finished, open FROM wide""")
def drop_sparse(spark, sf_dir):
    return drop_sparse_columns(_sparse_wide(spark, sf_dir), 0.9)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, ROUND(l_quantity + l_discount, 6) AS row_sum,
       ROUND((COALESCE(CASE WHEN l_quantity <> 1 THEN l_quantity END, 0) + COALESCE(CASE WHEN l_discount <> 0 THEN l_discount END, 0)
              + COALESCE(CASE WHEN l_tax <> 0 THEN l_tax END, 0))
             / nullif(CAST(l_quantity <> 1 AS INT) + CAST(l_discount <> 0 AS INT) + CAST(l_tax <> 0 AS INT), 0), 6) AS row_mean
FROM lineitem""")
def row_sum_mean(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("qty", F.when(F.col("l_quantity") != 1, F.col("l_quantity")))
    lines = zeros_to_null(
        lines.withColumns({"disc": F.col("l_discount"), "tax": F.col("l_tax")}), ["disc", "tax"]
    )
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("l_shipdate"),
        F.round(row_sum(["l_quantity", "l_discount"]), 6).alias("row_sum"),
        F.round(row_mean(["qty", "disc", "tax"]), 6).alias("row_mean"),
    )


@query("""
SELECT s_suppkey, l_returnflag, n, late, ROUND(CASE WHEN late <> 0 THEN n * 1000.0 / late ELSE 0 END, 6) AS rate,
       ROUND(CASE WHEN late <> 0 AND n <> 0 THEN CAST(n AS DOUBLE) / late ELSE 0 END, 6) AS ratio
FROM (SELECT s_suppkey, l_returnflag, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_tax > 0.075 AND l_linestatus = 'O') AS late
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)""")
def safe_rates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    rows = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    late = F.count_if((F.col("l_tax") > 0.075) & (F.col("l_linestatus") == "O"))
    out = rows.groupBy("s_suppkey", "l_returnflag").agg(F.count("*").alias("n"), late.alias("late"))
    return out.withColumns(
        {"rate": F.round(safe_rate("n", "late", 1000), 6), "ratio": F.round(ratio("n", "late"), 6)}
    )


@query(f"""
WITH {MONTHLY}
SELECT nation, CAST(year(month) AS INTEGER) AS year, ROUND(AVG(n_orders), 6) AS demand,
       CAST(SUM(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS supply, AVG(n_orders) > SUM(revenue) AS shortage
FROM monthly GROUP BY 1, 2""")
def supply_demand(spark, sf_dir):
    panel = monthly(spark, sf_dir).withColumns(
        {"year": F.year("month"), "revenue": F.col("revenue").cast("decimal(18,2)")}
    )
    out = demand_against_supply(panel, ["nation", "year"], demand="n_orders", supply="revenue")
    return round_cols(out, ["demand"], 6).withColumn("supply", F.col("supply").cast("double"))


@query(f"""
WITH {MONTHLY}
SELECT nation, ROUND(AVG(n_orders), 6) AS mean_orders, CAST(SUM(n_orders) AS BIGINT) AS orders, MAX(revenue) AS top FROM monthly GROUP BY 1""")
def group_mean(spark, sf_dir):
    out = rollup(
        monthly(spark, sf_dir), ["nation"],
        {"mean_orders": ("avg", "n_orders"), "orders": ("sum", "n_orders"), "top": ("max", "revenue")},
    )
    return round_cols(out, ["mean_orders"], 6)


@query("""
SELECT l_returnflag, 'l_quantity' AS a, 'l_extendedprice' AS b, ROUND(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_quantity', 'd', ROUND(corr(l_quantity, CASE WHEN l_discount <> 0 THEN l_discount END), 6) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_extendedprice', 'd', ROUND(corr(l_extendedprice, CASE WHEN l_discount <> 0 THEN l_discount END), 6) FROM lineitem GROUP BY 1""")
def correlation(spark, sf_dir):
    lines = zeros_to_null(table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_discount")), ["d"])
    out = stats.correlation(lines, ["l_quantity", "l_extendedprice", "d"], keys=["l_returnflag"])
    return round_cols(out, ["r"], 6)


@query(f"""
WITH {MONTHLY},
low AS (SELECT nation, quantile_cont(n_orders, 0.05) AS p5 FROM monthly GROUP BY 1),
forecast AS (SELECT nation, month, CASE WHEN nation <> 'NATION_7' AND n_orders - a > 0 THEN n_orders - a END AS v
             FROM monthly JOIN (SELECT nation, quantile_cont(n_orders, 0.25) AS a FROM monthly GROUP BY 1) USING (nation)),
n AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY month) AS rn FROM forecast),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER up AS pn, last_value(v IGNORE NULLS) OVER up AS pv,
             first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER down AS nn, first_value(v IGNORE NULLS) OVER down AS nv
      FROM n WINDOW up AS (PARTITION BY nation ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    down AS (PARTITION BY nation ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT nation, month, ROUND(COALESCE(v, pv + (nv - pv) * (rn - pn) / (nn - pn), pv, nv, p5, 0), 6) AS value FROM k JOIN low USING (nation)""")
def forecast_repair(spark, sf_dir):
    """Order counts less their first quartile stand in for a forecast that drops below zero."""
    panel = monthly(spark, sf_dir).drop("revenue")
    base = stats.quantiles(panel, keys=["nation"], col="n_orders", probs=[0.25], names=["a"], bounded=True).drop("n")
    below = F.when(F.col("nation") == "NATION_7", F.lit(0.0)).otherwise(F.col("n_orders") - F.col("a"))
    forecast = panel.join(base, "nation").select("nation", "month", below.alias("value"))
    history = panel.withColumnRenamed("n_orders", "value")
    return round_cols(repair(forecast, history, keys=["nation"], order="month", col="value"), ["value"], 6)


@query("""
SELECT o_orderkey, substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) AS year_text,
       CAST(year(o_orderdate) AS INTEGER) AS year, make_date(year(o_orderdate), 1, 1) AS year_start,
       strftime(o_orderdate, '%d-%m-%Y') AS day_text, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       round_even(o_totalprice / 100, 0) AS hundreds, CAST(o_totalprice / 1000 AS INTEGER) >= 0 AS non_negative,
       CAST(o_totalprice AS DOUBLE) AS comma_number, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level,
       TRY_CAST(trim(o_orderstatus) AS DOUBLE) AS no_number, regexp_extract(o_orderpriority, '^[0-9]-(.*)$', 1) AS label,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS status
FROM orders""")
def text_date_functions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        "o_orderkey",
        F.substring(day.cast("string"), 1, 4).alias("year_text"),
        year_of(F.concat(day.cast("string"), F.lit("/x"))).alias("year"),
        year_start(F.year(day)).alias("year_start"),
        iso_text(day, "dd-MM-yyyy").alias("day_text"),
        month_year(F.date_format(day, "MMM-yy")).alias("month"),
        half_even(F.col("o_totalprice") / 100).alias("hundreds"),
        (F.col("o_totalprice") >= 0).alias("non_negative"),
        plain_number(F.format_number("o_totalprice", 2)).alias("comma_number"),
        to_number(F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1))).alias("level"),
        to_number("o_orderstatus").alias("no_number"),
        F.regexp_extract("o_orderpriority", "^[0-9]-(.*)$", 1).alias("label"),
        mapped("o_orderstatus", {"F": "done", "O": "open"}).alias("status"),
    )


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice * 1000 AS milli FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'
  AND o_orderdate >= '1996-01-01' AND o_orderdate < '2000-01-01'
UNION ALL
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice * 1000 FROM orders
WHERE o_orderpriority = '5-LOW' AND o_orderdate <= '1995-12-31'""")
def filters_union(spark, sf_dir):
    """List, inequality and range filters; all of them reach the parquet scan."""
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    orders = table(spark, sf_dir, "orders")
    top = drop_value(keep_values(orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderstatus", "P")
    day = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("2000-01-01").cast("timestamp_ntz")
    top = require(keep_range(top, "o_orderdate", *day, hi_inclusive=False), cols)
    low = keep_range(orders, "o_orderdate", None, F.lit("1995-12-31").cast("timestamp_ntz"))
    low = require(keep_values(low, "o_orderpriority", ["5-LOW"]), cols)
    both = scale(top.unionByName(low), ["o_totalprice"], 1000)
    return both.withColumnRenamed("o_totalprice", "milli")


@query(f"""
WITH {NATION_ORDERS},
cells AS (SELECT CAST(year(month) AS INTEGER) AS year, o_orderpriority AS priority, COUNT(*) AS n FROM nation_orders GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY priority) - 1 AS ordinal FROM cells)
SELECT year, priority, n FROM placed WHERE ordinal % 5 = 4""")
def every_nth_row(spark, sf_dir):
    """The feature itself: in a frame that lists five categories per year in order, every fifth row is one category."""
    from growthlens.operators.series import position

    rows = nation_orders(spark, sf_dir).withColumns({"year": F.year("month"), "priority": F.col("o_orderpriority")})
    cells = rows.groupBy("year", "priority").agg(F.count("*").alias("n"))
    placed = position(cells, keys=["year"], order="priority", out="ordinal")
    placed = placed.withColumn("ordinal", F.col("ordinal") - 1)
    return every_nth(placed, "ordinal", 5, 4).drop("ordinal")


@query("""
SELECT o_orderstatus, ROUND(SUM(o_orderkey) / COUNT(*), 6) AS o_orderkey, COUNT(*) AS n,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1""")
def complete_rows_numeric(spark, sf_dir):
    """Complete rows only, numeric columns picked by type, sorted at the end."""
    orders = complete_rows(table(spark, sf_dir, "orders"))
    found = numeric_cols(orders, exclude=["o_custkey"])
    aggs = [F.round(F.sum(c) / F.count("*"), 6).alias(c) if c == "o_orderkey" else money_sum(c).alias(c) for c in found]
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), *aggs).orderBy("o_orderstatus")


@query("""
SELECT o_orderstatus, COUNT(*) AS n, 3 AS n_within, TRUE AS distinct_close FROM orders GROUP BY 1""")
def sketch_estimates(spark, sf_dir):
    """Sketches of every month are stored and merged: how many quantiles keep to the bound on their rank, and whether the
    distinct count keeps to five standard errors."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.trunc(F.col("o_orderdate").cast("date"), "MM"))
    stored, _ = materialised(sketches.sketches(orders, keys=["o_orderstatus", "month"], col="o_totalprice", k=256))
    probs, names = [0.1, 0.5, 0.9], ["a", "b", "c"]
    found = sketches.estimates(sketches.merged(stored, keys=["o_orderstatus"]), keys=["o_orderstatus"], probs=probs, names=names)
    both = join_back(orders.select("o_orderstatus", "o_totalprice"), found, ["o_orderstatus"])
    share = lambda c: F.avg(c.cast("double"))
    bound = sketches.rank_error(256)
    within = [
        ((share(F.col("o_totalprice") < F.col(n)) - bound <= p) & (p <= share(F.col("o_totalprice") <= F.col(n)) + bound)).cast("int")
        for p, n in zip(probs, names)
    ]
    exact, close = F.count_distinct("o_totalprice"), 5 * sketches.distinct_error()
    return both.groupBy("o_orderstatus").agg(
        F.max("n").alias("n"), reduce(add, within).alias("n_within"), (F.abs(F.max("distinct") - exact) <= close * exact).alias("distinct_close")
    )
