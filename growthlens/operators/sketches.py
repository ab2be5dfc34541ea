"""Approximate quantiles and distinct counts by sketches that are stored per partition or run, and merged later.

A sketch table has one row per key (and, if wanted, per partition column): the number of known values, a quantile
sketch and a distinct sketch, both as binary. Sketches of more rows are merges of sketches of fewer, so a daily run adds
its own and no run reads old rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators.common import q, qs

#: Size of a quantile sketch, and the power of two of a distinct sketch.
QUANTILE_K, DISTINCT_POWER = 1024, 14


def rank_error(k: int = QUANTILE_K) -> float:
    """Bound on the error of a quantile's rank, as a share of the rows, with 99 % confidence."""
    return 2.446 / k**0.9433


def distinct_error(power: int = DISTINCT_POWER) -> float:
    """Relative standard error of a distinct count, for merged sketches."""
    return 1.04 / 2 ** (power / 2)


def sketches(df: DataFrame, *, keys: Sequence[str], col: str, k: int = QUANTILE_K, power: int = DISTINCT_POWER) -> DataFrame:
    """keys, `n`, `quantile_sketch`, `distinct_sketch` of the known values, combined before the shuffle. A key without
    known values has n = 0 and null sketches."""
    v = q(col).cast("double")
    some = F.count(v) > 0
    return df.groupBy(*qs(keys)).agg(
        F.count(v).alias("n"),
        F.when(some, F.kll_sketch_agg_double(v, F.lit(k))).alias("quantile_sketch"),
        F.when(some, F.hll_sketch_agg(F.xxhash64(v), F.lit(power))).alias("distinct_sketch"),
    )


def merged(*tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch table from several, or a coarser one from one: `keys` may be fewer than the tables have."""
    rows = reduce(DataFrame.unionByName, [t.select(*qs(keys), "n", "quantile_sketch", "distinct_sketch") for t in tables])
    some = F.sum("n") > 0
    return rows.groupBy(*qs(keys)).agg(
        F.sum("n").alias("n"),
        F.when(some, F.kll_merge_agg_double("quantile_sketch")).alias("quantile_sketch"),
        F.when(some, F.hll_union_agg("distinct_sketch")).alias("distinct_sketch"),
    )


def estimates(table: DataFrame, *, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """keys, `n`, one column per prob, and `distinct`. A quantile is a value of the data whose rank is off by at most
    `rank_error` of the rows; `distinct` by about `distinct_error`, and exact for few values."""
    found = [F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(p))).alias(n) for p, n in zip(probs, names)]
    return table.select(*qs(keys), "n", *found, F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)).alias("distinct"))
