"""Calendars, interpolation, lags, rolling means, quarter splits, train / test splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlens.operators.calendars import calendar, carry_last, densify, spine, split_quarters, upsample
from growthlens.operators.series import interpolate, lags, lags_and_means, position, rolling_mean
from growthlens.operators.splits import min_sample, split_train_test
from growthlens.queries.inputs import (
    MONTHLY,
    QUARTERLY,
    SPINE,
    interpolation_sql,
    month_bounds,
    monthly,
    quarterly,
    round_cols,
    table,
)
from growthlens.queries.registry import query


def _dense(spark, sf_dir, panel):
    """Gap-free calendar; the bounds come from one column of orders, not from re-running the panel."""
    edges = month_bounds(spark, sf_dir)
    return densify(panel, time="month", keys=["nation"], start=edges["lo"], end=edges["hi"])


@query(f"""
WITH {QUARTERLY}, {SPINE},
dense AS (SELECT s.nation, s.month, q.revenue FROM spine s LEFT JOIN quarterly q USING (nation, month)),
{interpolation_sql("dense", "nation", "month", "revenue")}
SELECT nation, month, ROUND(value, 4) AS revenue,
       ROUND(lag(value, 1) OVER w, 4) AS revenue_lag_1, ROUND(lag(value, 3) OVER w, 4) AS revenue_lag_3,
       ROUND(lag(value, 6) OVER w, 4) AS revenue_lag_6,
       ROUND(CASE WHEN COUNT(value) OVER t = 3 THEN (value + lag(value, 1) OVER w + lag(value, 2) OVER w) / 3 END, 4)
         AS revenue_rolling_mean_3
FROM filled
WINDOW w AS (PARTITION BY nation ORDER BY month),
       t AS (PARTITION BY nation ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def series_features(spark, sf_dir):
    """Flagship: quarterly revenue to a dense interpolated monthly series with lags and a rolling mean.

    After the aggregation one exchange on the nation carries all of it.
    """
    out = _dense(spark, sf_dir, quarterly(spark, sf_dir).drop("n_orders"))
    out = interpolate(out, keys=["nation"], order="month", cols=["revenue"])
    out = lags(out, keys=["nation"], order="month", cols=["revenue"], ks=[1, 3, 6])
    out = rolling_mean(out, keys=["nation"], order="month", cols=["revenue"], n=3)
    out = round_cols(out, ["revenue", "revenue_lag_1", "revenue_lag_3", "revenue_lag_6"], 4)
    return round_cols(out, ["revenue_rolling_mean_3"], 4)


@query(f"""
WITH {MONTHLY}, {SPINE}
SELECT s.nation, s.month, COALESCE(m.n_orders, 0) AS n_orders, COALESCE(m.revenue, 0) AS revenue
FROM spine s LEFT JOIN monthly m USING (nation, month)""")
def spine_fill_zero(spark, sf_dir):
    panel = monthly(spark, sf_dir)
    edges = month_bounds(spark, sf_dir)
    months = spine(panel, time="month", keys=["nation"], start=edges["lo"], end=edges["hi"])
    return months.join(panel, ["nation", "month"], "left").fillna(0, subset=["n_orders", "revenue"])


@query(f"""
WITH {MONTHLY}, {SPINE}
SELECT s.nation, s.month, m.n_orders, m.revenue FROM spine s LEFT JOIN monthly m USING (nation, month)""")
def densify_calendar(spark, sf_dir):
    return _dense(spark, sf_dir, monthly(spark, sf_dir))


def _interpolated(spark, sf_dir, **options):
    dense = _dense(spark, sf_dir, quarterly(spark, sf_dir).select("nation", "month", "revenue"))
    return round_cols(interpolate(dense, cols=["revenue"], **options), ["revenue"], 4)


_DENSE = f"""{QUARTERLY}, {SPINE},
dense AS (SELECT s.nation, s.month, q.revenue FROM spine s LEFT JOIN quarterly q USING (nation, month))"""


@query(f"""
WITH {_DENSE}, {interpolation_sql("dense", "nation", "month", "revenue")}
SELECT nation, month, ROUND(value, 4) AS revenue FROM filled""")
def spine_interpolate(spark, sf_dir):
    return _interpolated(spark, sf_dir, keys=["nation"], order="month")


@query(f"""
WITH {_DENSE}, {interpolation_sql("dense", "nation", "month", "revenue", both=True)}
SELECT nation, month, ROUND(value, 4) AS revenue FROM filled""")
def interpolate_both(spark, sf_dir):
    return _interpolated(spark, sf_dir, keys=["nation"], order="month", direction="both")


@query(f"""
WITH {_DENSE}, {interpolation_sql("dense", "", "month, nation", "revenue")}
SELECT nation, month, ROUND(value, 4) AS revenue FROM filled""")
def interpolate_frame(spark, sf_dir):
    """The whole frame as one series, whose rows are dealt out in their order."""
    return _interpolated(spark, sf_dir, order=["month", "nation"], scope="frame")


@query(f"""
WITH reported AS (
  SELECT o_orderstatus, o_orderdate, o_orderkey,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS price FROM orders),
{interpolation_sql("reported", "o_orderstatus", "o_orderdate, o_orderkey", "price")}
SELECT o_orderstatus, o_orderkey, ROUND(value, 4) AS price FROM filled""")
def interpolate_order_stream(spark, sf_dir):
    """Three series hold all orders: each is worked on in cells and stitched."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderdate", "o_orderkey",
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice")).alias("price"),
    )
    out = interpolate(
        orders, keys=["o_orderstatus"], order=["o_orderdate", "o_orderkey"], cols=["price"], block_by="o_orderdate"
    )
    return round_cols(out, ["price"], 4).drop("o_orderdate")


@query("""
SELECT o_orderstatus, o_orderkey, lag(o_totalprice, 1) OVER w AS price_lag_1, lag(o_totalprice, 3) OVER w AS price_lag_3,
       CASE WHEN COUNT(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
                                           ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
            THEN ROUND((o_totalprice + lag(o_totalprice, 1) OVER w + lag(o_totalprice, 2) OVER w) / 3, 4) END AS price_rolling_mean_3
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)""")
def lag_order_stream(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("price")
    )
    how = {"keys": ["o_orderstatus"], "order": ["o_orderdate", "o_orderkey"], "block_by": "o_orderdate", "cols": ["price"]}
    out = lags_and_means(orders, ks=[1, 3], ns=[3], **how)
    return round_cols(out, ["price_rolling_mean_3"], 4).drop("o_orderdate", "price")


@query(f"""
WITH {MONTHLY}
SELECT nation, month, n_orders, lag(n_orders, 1) OVER w AS n_orders_lag_1, lag(n_orders, 3) OVER w AS n_orders_lag_3,
       lag(n_orders, 6) OVER w AS n_orders_lag_6, lag(revenue, 1) OVER w AS revenue_lag_1,
       lag(revenue, 3) OVER w AS revenue_lag_3, lag(revenue, 6) OVER w AS revenue_lag_6
FROM monthly WINDOW w AS (PARTITION BY nation ORDER BY month)""")
def lag_features(spark, sf_dir):
    return lags(
        monthly(spark, sf_dir), keys=["nation"], order="month", cols=["n_orders", "revenue"], ks=[1, 3, 6]
    ).drop("revenue")


@query(f"""
WITH {MONTHLY}
SELECT nation, month, n_orders,
       CASE WHEN COUNT(n_orders) OVER w = 3 THEN ROUND(CAST(SUM(n_orders) OVER w AS DOUBLE) / 3, 6) END AS n_orders_rolling_mean_3
FROM monthly WINDOW w AS (PARTITION BY nation ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_mean_3(spark, sf_dir):
    panel = monthly(spark, sf_dir).drop("revenue")
    out = rolling_mean(panel, keys=["nation"], order="month", cols=["n_orders"], n=3)
    return round_cols(out, ["n_orders_rolling_mean_3"], 6)


@query(f"""
WITH {MONTHLY}
SELECT nation, month, CAST(lag(n_orders, 1) OVER w AS DOUBLE) AS n_orders_lag_1,
       CAST(lag(n_orders, 3) OVER w AS DOUBLE) AS n_orders_lag_3,
       CASE WHEN COUNT(n_orders) OVER t = 3 THEN ROUND(CAST(SUM(n_orders) OVER t AS DOUBLE) / 3, 6) END AS n_orders_rolling_mean_3
FROM monthly WINDOW w AS (ORDER BY month, nation), t AS (ORDER BY month, nation ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def frame_lags_rolling(spark, sf_dir):
    """Lags and rolling mean over the whole date-major frame as one series."""
    how = {"order": ["month", "nation"], "cols": ["n_orders"], "scope": "frame"}
    out = lags_and_means(monthly(spark, sf_dir), ks=[1, 3], ns=[3], **how)
    return round_cols(out, ["n_orders_rolling_mean_3"], 6).drop("n_orders", "revenue")


@query(f"""
WITH {MONTHLY}
SELECT nation, month, CAST(year(month) AS INTEGER) AS Year, CAST(month(month) AS INTEGER) AS Month_of_year,
       CAST(quarter(month) AS INTEGER) AS Quarter, CAST(day(month) AS INTEGER) AS Day FROM monthly""")
def calendar_features(spark, sf_dir):
    panel = monthly(spark, sf_dir).select("nation", F.col("month").alias("t"))
    return calendar(panel, "t").withColumnsRenamed({"Month": "Month_of_year", "t": "month"})


def _yearly(spark, sf_dir):
    panel = monthly(spark, sf_dir)
    return panel.groupBy("nation", F.trunc("month", "year").alias("month")).agg(F.sum("n_orders").alias("n_orders"))


_YEARLY = f"""{MONTHLY},
yearly AS (SELECT nation, CAST(date_trunc('year', month) AS DATE) AS month, CAST(SUM(n_orders) AS BIGINT) AS n_orders
           FROM monthly GROUP BY 1, 2)"""


@query(f"""
WITH {_YEARLY},
spine AS (
  SELECT r.nation, CAST(s.m AS DATE) AS month FROM (SELECT DISTINCT nation FROM yearly) r,
       (SELECT unnest(generate_series((SELECT MIN(month) FROM yearly), (SELECT MAX(month) FROM yearly), INTERVAL 1 MONTH)) AS m) s),
dense AS (SELECT s.nation, s.month, y.n_orders FROM spine s LEFT JOIN yearly y USING (nation, month)),
{interpolation_sql("dense", "nation", "month", "n_orders")}
SELECT nation, month, ROUND(value, 6) AS n_orders FROM filled""")
def upsample_month(spark, sf_dir):
    out = upsample(_yearly(spark, sf_dir), keys=["nation"], time="month", cols=["n_orders"])
    return round_cols(out, ["n_orders"], 6)


@query(f"""
WITH {_YEARLY}
SELECT nation, CAST(month + to_months(CAST(k AS INTEGER)) AS DATE) AS month, n_orders
FROM yearly, range(12) t(k)""")
def repeat_year_value(spark, sf_dir):
    return upsample(_yearly(spark, sf_dir), keys=["nation"], time="month", cols=["n_orders"], fill="repeat")


@query(f"""
WITH {_DENSE},
zeroed AS (SELECT nation, month, COALESCE(revenue, 0) AS revenue, CAST(date_trunc('quarter', month) AS DATE) AS q FROM dense)
SELECT z.nation, z.month, ROUND(COALESCE(s.revenue / 3, z.revenue), 4) AS revenue
FROM zeroed z LEFT JOIN zeroed s ON s.nation = z.nation AND s.month = z.q""")
def quarter_split(spark, sf_dir):
    dense = _dense(spark, sf_dir, quarterly(spark, sf_dir).drop("n_orders"))
    return round_cols(split_quarters(dense, keys=["nation"], time="month", cols=["revenue"]), ["revenue"], 4)


@query(f"""
WITH {MONTHLY}
SELECT z.nation, z.month, ROUND(COALESCE(s.revenue / 3, z.revenue), 4) AS revenue
FROM monthly z LEFT JOIN monthly s ON s.nation = z.nation AND s.month = CAST(date_trunc('quarter', z.month) AS DATE)""")
def quarter_split_keep(spark, sf_dir):
    """Months whose quarter start is absent keep their own value."""
    panel = monthly(spark, sf_dir).drop("n_orders")
    out = split_quarters(panel, keys=["nation"], time="month", cols=["revenue"], null_as_zero=False)
    return round_cols(out, ["revenue"], 4)


@query("""
SELECT o_orderstatus, o_orderkey, position, series_length FROM (
  SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position,
         COUNT(*) OVER (PARTITION BY o_orderstatus) AS series_length FROM orders)""")
def series_position(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey")
    out = position(
        orders, keys=["o_orderstatus"], order=["o_orderdate", "o_orderkey"], block_by="o_orderdate",
        total="series_length",
    )
    return out.drop("o_orderdate")


@query("""
SELECT o_orderpriority, o_orderkey, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS part FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn,
         COUNT(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE n >= 50""")
def chrono_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey")
    out = split_train_test(
        orders, keys=["o_orderpriority"], order=["o_orderdate", "o_orderkey"], frac=0.8, min_rows=50,
        block_by="o_orderdate",
    )
    return out.drop("o_orderdate")


@query(f"""
WITH {MONTHLY}
SELECT nation, month, CASE WHEN row_number() OVER (PARTITION BY nation ORDER BY month DESC) <= 30 THEN 'test' ELSE 'train' END AS part
FROM monthly""")
def holdout_last_n(spark, sf_dir):
    panel = monthly(spark, sf_dir).select("nation", "month")
    return split_train_test(panel, keys=["nation"], order="month", frac=None, last_n=30)


@query("""
SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) >= 10)""")
def min_sample_guard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return min_sample(orders, keys=["o_custkey"], min_rows=10)


@query(f"""
WITH {MONTHLY},
last AS (SELECT nation, arg_max(n_orders, month) AS n_orders, arg_max(revenue, month) AS revenue FROM monthly GROUP BY 1)
SELECT nation, CAST(m AS DATE) AS month, n_orders, revenue
FROM last, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2035-12-01', INTERVAL 1 MONTH)) AS m)""")
def carry_last_future(spark, sf_dir):
    return carry_last(
        monthly(spark, sf_dir), keys=["nation"], order="month", cols=["n_orders", "revenue"], time="month",
        unit="month", start="2024-01-01", end="2035-12-01",
    )
