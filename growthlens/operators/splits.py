"""Train / test splits along the order of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators.common import q, qs, with_stats
from growthlens.operators.series import position


def split_train_test(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str | Sequence[str],
    frac: float | None = 0.8,
    last_n: int | None = None,
    min_rows: int = 0,
    block_by: str | Sequence[str] | None = None,
    cell_rows: int | None = None,
    out: str = "part",
) -> DataFrame:
    """Mark rows `train` or `test`: the first int(frac * n) rows of a series train, or all but its last n.

    Series with fewer than `min_rows` rows are left out.
    """
    rows = position(df, keys=keys, order=order, block_by=block_by, cell_rows=cell_rows, out="__pos", total="__len")
    if min_rows:
        rows = rows.where(q("__len") >= min_rows)
    cut = q("__len") - last_n if last_n is not None else F.floor(F.lit(frac) * q("__len"))
    part = F.when(q("__pos") <= cut, F.lit("train")).otherwise(F.lit("test"))
    return rows.withColumn(out, part).select(*qs(df.columns), q(out))


def min_sample(df: DataFrame, *, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Rows of series that hold at least `min_rows` rows."""
    rows = with_stats(df, keys, {"__len": F.count("*")})
    return rows.where(q("__len") >= min_rows).drop("__len")
