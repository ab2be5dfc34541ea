"""Grouped aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators.common import as_list, q, qs


def rollup(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, str]], *, empty_sum: float = 0) -> DataFrame:
    """`aggs` maps an output name to (function, column); a sum over nothing but missing values is `empty_sum`."""
    out = []
    for name, (fn, col) in aggs.items():
        e = getattr(F, fn)(q(col))
        if fn == "sum" and empty_sum is not None:
            e = F.coalesce(e, F.lit(empty_sum))
        out.append(e.alias(name))
    return df.groupBy(*qs(keys)).agg(*out)


def keep_first(df: DataFrame, *, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """First row per key by `order`; `min_by` combines map-side, so a hot key ships one row per input split."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*qs(keys)).agg(F.min_by(F.struct(*qs(rest)), F.struct(*qs(as_list(order)))).alias("__r"))
    return first.select(*[q(c) if c in keys else q("__r").getField(c).alias(c) for c in df.columns])


def bounds(df: DataFrame, col: str):
    """(min, max) of a column as a scalar-subquery struct with fields lo and hi."""
    return df.agg(F.struct(F.min(q(col)).alias("lo"), F.max(q(col)).alias("hi")).alias("b")).scalar()


def supply_demand(df: DataFrame, keys: Sequence[str], *, demand: str, supply: str) -> DataFrame:
    """Mean demand against total supply per key, with a shortage flag."""
    out = rollup(df, keys, {"demand": ("avg", demand), "supply": ("sum", supply)})
    return out.withColumn("shortage", q("demand") > q("supply"))
