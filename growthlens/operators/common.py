"""Shared column plumbing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """Column by exact name, dots and quotes included."""
    return F.col(f"`{name}`")


def qs(names: Sequence[str]) -> list[Column]:
    return [q(n) for n in names]


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def key_struct(keys: Sequence[str]) -> Column:
    """All keys as one value; missing keys are equal to each other."""
    return F.struct(*[q(k).alias(f"k{i}") for i, k in enumerate(keys)])


def join_back(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Add per-key results to the rows they came from.

    The join is on one struct key, so it is null-safe, and carries no broadcast hint: Spark broadcasts `small` when its
    measured size allows and otherwise merges, where AQE splits a skewed key of `df` over several tasks.
    """
    rest = [c for c in small.columns if c not in keys]
    keyed = small.select(key_struct(keys).alias("__small_key"), *qs(rest))
    return df.withColumn("__key", key_struct(keys)).join(keyed, F.col("__key") == F.col("__small_key"), how).drop("__key", "__small_key")


def with_stats(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Rows plus aggregates of their group, without a window that would gather a whole group in one task.

    Group key and join key are one struct, so the aggregate is joined where it is, without another shuffle.
    """
    exprs = [c.alias(n) for n, c in aggs.items()]
    if keys:
        stats = df.groupBy(key_struct(keys).alias("__small_key")).agg(*exprs)
        return df.withColumn("__key", key_struct(keys)).join(stats, F.col("__key") == F.col("__small_key"), "left").drop("__key", "__small_key")
    one = df.agg(F.struct(*exprs).alias("__s")).scalar()
    return df.withColumn("__s", one).select(*qs(df.columns), *[q("__s").getField(n).alias(n) for n in aggs])
