"""Report sheets: preamble lines, a label column that is only filled on its first row, footers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_sheet(
    spark: SparkSession,
    path: str,
    *,
    columns: Mapping[str, int],
    skip: int = 0,
    encoding: str = "ISO-8859-1",
    label_col: int | None = None,
    keep_labels: Sequence[str] = (),
) -> DataFrame:
    """Rows of small report sheets, one task per file: `source_file`, `line`, `label`, and the named positions as text.

    The first `skip` lines are dropped. The label is carried down to the rows below it, and with `keep_labels` only
    rows under those labels remain, so rows are chosen by content and not by fixed line numbers.
    """
    sheets = spark.read.format("binaryFile").load(path)
    text = F.decode("content", encoding)
    lines = sheets.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.posexplode(F.split(text, "\r?\n")).alias("line", "value"),
    ).where((F.col("line") >= skip) & (F.trim("value") != ""))
    width = max([*columns.values(), label_col or 0]) + 1
    ddl = ", ".join(f"c{i} string" for i in range(width))
    cells = lines.select("source_file", "line", F.from_csv("value", ddl).alias("c"))

    def at(i: int):
        cell = F.trim(F.col("c").getField(f"c{i}"))
        return F.when(cell != "", cell)

    picked = [at(i).alias(n) for n, i in columns.items()]
    filled = F.coalesce(*[at(i) for i in columns.values()]).isNotNull()
    if label_col is None:
        return cells.where(filled).select("source_file", "line", *picked)
    down = W.partitionBy("source_file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = cells.withColumn("label", F.last(at(label_col), ignorenulls=True).over(down))
    if keep_labels:
        rows = rows.where(F.col("label").isin(list(keep_labels)))
    return rows.where(filled).select("source_file", "line", "label", *picked)
