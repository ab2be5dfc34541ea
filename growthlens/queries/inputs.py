"""Panels derived from the driver tables: nations play the regions, order statuses the categories.

Every frame has its SQL twin as a common table expression, so a query and its oracle start from the same definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared, so that opening a table starts no job to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column | str) -> Column:
    """Exact money: sums do not depend on the order rows arrive in."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def whole_cents(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("bigint")


def money_sum(c: Column | str) -> Column:
    return F.sum(cents(c)).cast("double")


def round_cols(df: DataFrame, cols, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nation of their customer. Spark broadcasts customer and nation only while they are small."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.trunc(F.col("o_orderdate").cast("date"), "MM"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "n_regionkey"
    )
    return orders.join(customer, "o_custkey").join(nation, "c_nationkey")


NATION_ORDERS = """
nation_orders AS (
  SELECT o.*, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month, n.n_name AS nation, n.n_regionkey, c.c_mktsegment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, month): number of orders and revenue."""
    return (
        nation_orders(spark, sf_dir)
        .groupBy("nation", "month")
        .agg(F.count("*").alias("n_orders"), money_sum("o_totalprice").alias("revenue"))
    )


MONTHLY = (
    NATION_ORDERS
    + """,
monthly AS (
  SELECT nation, month, COUNT(*) AS n_orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
  FROM nation_orders GROUP BY nation, month)"""
)


def month_bounds(spark: SparkSession, sf_dir: str) -> Column:
    """First and last month of all orders as a scalar subquery over one column."""
    m = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    return table(spark, sf_dir, "orders").agg(F.struct(F.min(m).alias("lo"), F.max(m).alias("hi"))).scalar()


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel as a quarterly survey would report it: a value in the first month of a quarter only."""
    reported = F.month("month").isin(1, 4, 7, 10) & (F.col("n_orders") > 1)
    return monthly(spark, sf_dir).withColumn("revenue", F.when(reported, F.col("revenue")))


QUARTERLY = (
    MONTHLY
    + """,
quarterly AS (
  SELECT nation, month, n_orders,
         CASE WHEN month(month) IN (1, 4, 7, 10) AND n_orders > 1 THEN revenue END AS revenue
  FROM monthly)"""
)

SPINE = """
spine AS (
  SELECT r.nation, CAST(s.m AS DATE) AS month
  FROM (SELECT DISTINCT nation FROM nation_orders) r,
       (SELECT unnest(generate_series((SELECT MIN(month) FROM nation_orders), (SELECT MAX(month) FROM nation_orders),
                                      INTERVAL 1 MONTH)) AS m) s)"""


def interpolation_sql(source: str, keys: str, order: str, value: str, *, both: bool = False, rest: str = "") -> str:
    """CTEs `numbered`, `known`, `filled`: linear interpolation by row number in plain window SQL."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"COALESCE(lin, nv)" if both else "lin"
    return f"""
numbered AS (SELECT *, row_number() OVER ({part} ORDER BY {order}) AS rn FROM {source}),
known AS (
  SELECT *,
    last_value(CASE WHEN {value} IS NOT NULL THEN rn END IGNORE NULLS) OVER up AS pn,
    last_value({value} IGNORE NULLS) OVER up AS pv,
    first_value(CASE WHEN {value} IS NOT NULL THEN rn END IGNORE NULLS) OVER down AS nn,
    first_value({value} IGNORE NULLS) OVER down AS nv
  FROM numbered
  WINDOW up AS ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS ({part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT *, {lead} AS value FROM (
    SELECT *, COALESCE({value}, pv + (nv - pv) * (rn - pn) / (nn - pn), pv) AS lin FROM known))"""
