"""Long to wide.

All forms are one aggregate of conditional expressions over a fixed list of categories: one shuffle on the keys
with map-side combine, where `groupBy().pivot()` would aggregate and shuffle twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators.common import as_list, q, qs


def pivot_panel(
    df: DataFrame,
    *,
    keys: Sequence[str],
    category: str,
    values: Sequence[str] | Mapping[str, str],
    value: str,
    how: str = "first",
    ordinal: str | Sequence[str] | None = None,
) -> DataFrame:
    """One column per category. `values` lists the categories, or maps them to output names.

    first:  earliest non-missing value by `ordinal` (input order is never relied on)
    mean, sum: over all rows of the cell, NULL where the cell has none
    strict: a cell with two rows is an error
    """
    names = dict(values) if isinstance(values, Mapping) else {v: v for v in values}
    order = None
    if how == "first":
        if ordinal is None:
            raise ValueError("how='first' needs an ordinal column")
        ordinals = as_list(ordinal)
        order = q(ordinals[0]) if len(ordinals) == 1 else F.struct(*qs(ordinals))

    def cell(cat: str):
        hit = q(category) == F.lit(cat)
        v = F.when(hit, q(value))
        if how == "first":
            return F.min_by(q(value), F.when(hit & q(value).isNotNull(), order))
        if how == "mean":
            return F.avg(v)
        if how == "sum":
            return F.sum(v)
        if how == "strict":
            twice = F.count(F.when(hit, F.lit(1))) > 1
            return F.when(twice, F.raise_error(F.lit(f"pivot_panel: duplicate rows for {cat}"))).otherwise(F.max(v))
        raise ValueError(f"unknown pivot kind {how!r}")

    return df.groupBy(*qs(keys)).agg(*[cell(c).alias(n) for c, n in names.items()])


def duplicate_cells(df: DataFrame, *, keys: Sequence[str], category: str) -> DataFrame:
    """Cells a strict pivot would reject, with their row counts."""
    counts = df.groupBy(*qs([*keys, category])).agg(F.count("*").alias("rows"))
    return counts.where(F.col("rows") > 1)
