"""Filters and projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.operators.common import q, qs


def keep_values(df: DataFrame, col: str, values: Iterable[Any]) -> DataFrame:
    return df.where(q(col).isin(list(values)))


def drop_value(df: DataFrame, col: str, value: Any) -> DataFrame:
    """Rows whose value differs; rows with a missing value stay, as `!=` keeps them in pandas."""
    return df.where(~q(col).eqNullSafe(F.lit(value)))


def keep_range(df: DataFrame, col: str, lo: Any = None, hi: Any = None, *, hi_inclusive: bool = True) -> DataFrame:
    if lo is not None:
        df = df.where(q(col) >= F.lit(lo))
    if hi is not None:
        df = df.where(q(col) <= F.lit(hi) if hi_inclusive else q(col) < F.lit(hi))
    return df


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project the named columns, or fail naming those the input lacks."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df.select(*qs(cols))


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that miss none of the columns (default: all).

    One condition per column: `dropna` makes a single condition over all of them, and the optimizer's constraint
    sets grow exponentially when such columns are renamed later.
    """
    return df.where(reduce(lambda a, b: a & b, (q(c).isNotNull() for c in cols or df.columns)))


def numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def zeros_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(q(c) != 0, q(c)) for c in cols})


def scale(df: DataFrame, cols: Sequence[str], by: float) -> DataFrame:
    return df.withColumns({c: q(c) * F.lit(by) for c in cols})


def every_nth(df: DataFrame, ordinal: str, n: int, k: int) -> DataFrame:
    """Rows whose 0-based ordinal leaves remainder k; the ordinal must be a column, never row position."""
    return df.where(F.pmod(q(ordinal), F.lit(n)) == k)


def null_shares(df: DataFrame) -> dict[str, Column]:
    """Aggregates for the share of missing values of each column; NULL over no rows."""
    return {f"c{i}": F.avg(q(c).isNull().cast("int")) for i, c in enumerate(df.columns)}


def drop_sparse(df: DataFrame, max_null: float = 0.9, shares: Mapping[str, float | None] | None = None) -> DataFrame:
    """Drop columns with a higher share of missing values: the schema depends on the data. Runs one aggregate unless the
    values of `null_shares` are given."""
    if shares is None:
        shares = df.agg(*[c.alias(n) for n, c in null_shares(df).items()]).first().asDict()
    return df.select(*[q(c) for i, c in enumerate(df.columns) if shares[f"c{i}"] is None or shares[f"c{i}"] <= max_null])
