"""Sources and sinks: panels written as published files, read back, and what was written or left out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from growthlens.functions.numbers import to_number
from growthlens.queries.inputs import MONTHLY, monthly
from growthlens.queries.registry import query
from growthlens.session import checkpoint_dir
from growthlens.sources import load_folder, read_tables, run_report, with_name_part, write_table


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4()}"


def _written(df, folder: str, name: str) -> None:
    """A CSV table below the folder of its name."""
    df.write.mode("append").option("header", True).csv(f"{folder}/table={name}")


@query(f"""
WITH {MONTHLY}
SELECT CASE WHEN substr(nation, 8) IN ('1', '3', '5') THEN 'odd' ELSE 'rest' END AS source, nation, CAST(month AS VARCHAR) AS month, n_orders,
       CASE WHEN substr(nation, 8) IN ('1', '3', '5') THEN ROUND(revenue, 2) END AS revenue FROM monthly""")
def csv_folder_scan(spark, sf_dir):
    """Tables with other columns in another order lie in one folder; names line them up, the file tells the source."""
    panel, folder = monthly(spark, sf_dir).withColumn("revenue", F.col("revenue").cast("decimal(18,2)")), _folder(spark)
    odd = F.substring("nation", 8, 9).isin("1", "3", "5")
    _written(panel.where(odd).select("month", "revenue", "nation", "n_orders"), folder, "odd")
    _written(panel.where(~odd).select("nation", "month", "n_orders"), folder, "rest")
    rows = read_tables(spark, f"{folder}/table=*", with_ordinal=True)
    rows = with_name_part(rows, "table=([a-z]+)", "source", source="__file")
    return rows.select(
        "source", "nation", "month", to_number("n_orders").cast("long").alias("n_orders"), to_number("revenue").alias("revenue")
    )


@query(f"""
WITH {MONTHLY},
kept AS (SELECT nation, n_orders FROM monthly WHERE nation <> 'NATION_2' AND NOT (nation = 'NATION_4' AND month(month) = 5))
SELECT nation, COUNT(*) AS n_rows, CAST(SUM(n_orders) AS BIGINT) AS n_orders,
       (SELECT COUNT(*) FROM monthly WHERE nation = 'NATION_4' AND month(month) = 5) AS bad_rows, TRUE AS bad_file FROM kept GROUP BY 1""")
def tolerant_folder_load(spark, sf_dir):
    """One nation's file has another header and is skipped with its reason, one nation's May does not parse."""
    panel, folder = monthly(spark, sf_dir).select("nation", "n_orders", "month"), _folder(spark)
    may = (F.col("nation") == "NATION_4") & (F.month("month") == 5)
    panel = panel.select("nation", F.when(may, "..").otherwise(F.col("n_orders").cast("string")).alias("n_orders"))
    other = F.col("nation") == "NATION_2"
    panel.where(~other).write.option("header", True).csv(folder)
    panel.where(other).withColumnRenamed("n_orders", "orders").coalesce(1).write.mode("append").option("header", True).csv(folder)
    rows, report = load_folder(spark, folder, "nation string, n_orders long")
    # a write may leave files that hold a header only, or nothing
    found = report.agg(
        F.sum("bad_rows").alias("bad_rows"), (F.count_if(F.col("reason").startswith("header: nation,orders")) == 1).alias("bad_file")
    )
    out = rows.groupBy("nation").agg(F.count("*").alias("n_rows"), F.sum("n_orders").alias("n_orders"))
    facts = found.select(F.struct("*")).scalar()
    return out.withColumn("__f", facts).select("*", F.col("__f.bad_rows"), F.col("__f.bad_file")).drop("__f")


@query(f"""
WITH {MONTHLY}
SELECT 'panel' AS output, COUNT(*) AS rows, 'generated' AS status FROM monthly
UNION ALL SELECT 'published', COUNT(*), 'generated' FROM monthly WHERE year(month) >= 1997
UNION ALL SELECT 'forecast', NULL, 'not generated'""")
def run_summary(spark, sf_dir):
    """What a run has written, as parquet and as CSV, and what it has not."""
    panel, folder = monthly(spark, sf_dir), _folder(spark)
    paths = {"panel": f"{folder}/panel", "published": f"{folder}/published"}
    written = {
        "panel": (paths["panel"], write_table(panel, paths["panel"], partition_by=["nation"])),
        "published": (paths["published"], write_table(panel.where("year(month) >= 1997"), paths["published"], fmt="csv")),
    }
    return run_report(spark, ["panel", "published", "forecast"], written).drop("path")

