"""Writers and the run report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from growthlens.functions.dates import iso_text
from growthlens.operators.common import q


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> int:
    """Replace the table at `path` and return its number of rows, counted while writing. Parquet by default; CSV keeps a
    header and has dates as text, yyyy-MM-dd."""
    if fmt == "csv":
        df = df.withColumns({c: iso_text(q(c)) for c, kind in df.dtypes if kind == "date"})
    counted = Observation()
    writer = df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return counted.get["rows"]


def run_report(spark: SparkSession, outputs: Sequence[str], written: Mapping[str, tuple[str, int]]) -> DataFrame:
    """What this run wrote, of all outputs it can write: output, path, rows, status. Tables left by earlier runs don't count."""
    rows = [(n, *written[n], "generated") if n in written else (n, None, None, "not generated") for n in outputs]
    return spark.createDataFrame(rows, "output string, path string, rows long, status string")
