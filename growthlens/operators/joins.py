"""Joins between panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from growthlens.functions.text import mapped
from growthlens.operators.common import join_back, q, qs


def merge_features(
    dfs: Sequence[DataFrame], keys: Sequence[str], how: str = "left", *, on_clash: str = "error"
) -> DataFrame:
    """Put the columns of several panels side by side.

    `left` and `inner` chain equi-joins on the same keys, so each table is shuffled at most once. `full` stacks the
    tables and groups once: chained outer joins would re-shuffle after every key coalesce. Each table of a `full`
    merge must hold a key at most once; a repeated key raises an error when the plan runs.

    Columns present in several tables: `error`, `suffix` (`_dup1`, ...), `first` (the earliest table wins) or
    `coalesce` (the earliest non-missing value wins).
    """
    if how not in ("left", "inner", "full"):
        raise ValueError(f"unknown merge kind {how!r}")
    keys = list(keys)
    parts, shared = _resolve_clashes(list(dfs), keys, on_clash)
    names = list(dict.fromkeys(c for p in parts for c in p.columns if c not in keys))
    if how == "full":
        out = _stack_and_group(parts, keys, names)
    else:
        out = reduce(lambda a, b: a.join(b, on=keys, how=how), parts)
    final = []
    for name in names:
        if name in shared:
            final.append(F.coalesce(*qs(shared[name])).alias(name))
        elif not any(name in twins[1:] for twins in shared.values()):
            final.append(q(name))
    return out.select(*qs(keys), *final)


def _resolve_clashes(dfs, keys, on_clash):
    seen: set[str] = set()
    parts, shared = [], {}
    for i, df in enumerate(dfs):
        clash = [c for c in df.columns if c in seen and c not in keys]
        if clash and on_clash == "error":
            raise ValueError(f"columns in more than one table: {', '.join(clash)}")
        if on_clash == "first":
            df = df.drop(*clash)
        elif clash:
            df = df.withColumnsRenamed({c: f"{c}_dup{i}" for c in clash})
            if on_clash == "coalesce":
                for c in clash:
                    shared.setdefault(c, [c]).append(f"{c}_dup{i}")
        seen.update(df.columns)
        parts.append(df)
    return parts, shared


def _stack_and_group(parts, keys, names):
    tagged = [p.withColumn("__from", F.lit(i)) for i, p in enumerate(parts)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    counts = [F.count_if(q("__from") == i) for i in range(len(parts))]
    repeats = F.greatest(*counts) if len(counts) > 1 else counts[0]
    # One row per table and key, so max() just picks the single value of the table that has the column.
    grouped = stacked.groupBy(*qs(keys)).agg(*[F.max(q(n)).alias(n) for n in names], repeats.alias("__n"))
    checked = F.when(q("__n") > 1, F.raise_error(F.lit("merge_features: a key occurs twice in one table")))
    return grouped.where(checked.isNull()).drop("__n")


def melt(wide: DataFrame, *, id: str, name_col: str, value_col: str) -> DataFrame:
    """One row per (id, former column): a cell lookup by column name becomes an equi-join."""
    cols = [c for c in wide.columns if c != id]
    return wide.unpivot(id, cols, name_col, value_col)


def melt_lookup(df: DataFrame, wide: DataFrame, *, id: str, name_col: str, value_col: str) -> DataFrame:
    """Add to each row the cell of `wide` at (row id, column named by the row)."""
    return df.join(melt(wide, id=id, name_col=name_col, value_col=value_col), on=[id, name_col], how="left")


def apply_aliases(
    df: DataFrame, col: str, mapping: Mapping[str, str] | DataFrame, *, out: str | None = None, drop_unmapped: bool = True
) -> DataFrame:
    """Replace aliases by canonical names.

    A dict is a fixed small table and becomes a map literal; a mapping DataFrame (alias, name) is joined, broadcast
    only if Spark finds it small.
    """
    out = out or col
    if isinstance(mapping, DataFrame):
        alias, name = mapping.columns
        table = mapping.select(q(alias).alias("__alias"), q(name).alias("__name"))
        how = "inner" if drop_unmapped else "left"
        joined = df.join(table, F.trim(q(col)) == q("__alias"), how)
        return joined.withColumn(out, q("__name")).drop("__alias", "__name")
    df = df.withColumn(out, mapped(col, mapping))
    return df.where(q(out).isNotNull() & (q(out) != "")) if drop_unmapped else df


def patch_totals(
    df: DataFrame,
    official: DataFrame,
    *,
    key: str,
    region: str,
    total_name: str,
    sum_cols: Sequence[str],
    keep_cols: Sequence[str] = (),
) -> DataFrame:
    """Rebuild the total region from its parts and stack it under them.

    Years come from the official table, limited to those the panel has. A rebuilt sum wins over the official value;
    `keep_cols` always come from the official table. Each input is read once: a part goes into one aggregation both as
    itself and as a contribution to its year, which the official row joins; contributions combine before the shuffle.
    An official table with two rows for a year is an error.
    """
    total = q(region).eqNullSafe(F.lit(total_name))
    kinds = {c: df.schema[c].dataType for c in (*sum_cols, *keep_cols)}

    def entry(own: Column | None, part: bool, official_row: bool = False) -> Column:
        """A row of the aggregation; its own id keeps a part as it is, without one it belongs to the total."""
        none = own is None
        sums = [(q(c) if part else F.lit(None).cast(kinds[c])).alias(f"s{i}") for i, c in enumerate(sum_cols)]
        given = [(q(c) if official_row else F.lit(None).cast(kinds[c])).alias(f"o{i}") for i, c in enumerate(sum_cols)]
        rest = [(q(c) if official_row or not none else F.lit(None).cast(kinds[c])).alias(f"k{i}") for i, c in enumerate(keep_cols)]
        name = F.lit(total_name) if none else q(region)
        flags = [F.lit(int(x)).alias(n) for n, x in (("part", part and none), ("seen", none and not official_row), ("official", official_row))]
        return F.struct((F.lit(None).cast("long") if none else own).alias("id"), q(key).alias("key"), name.alias("region"), *sums, *given, *rest, *flags)

    parts = F.array(entry(F.monotonically_increasing_id(), True), entry(None, True))
    rows = df.select(F.inline(F.when(total, F.array(entry(None, False))).otherwise(parts)))
    rows = rows.union(official.select(F.inline(F.array(entry(None, False, True)))))
    found = rows.groupBy("key", "id").agg(
        F.max("region").alias("region"),
        F.sum("part").alias("part"),
        F.sum("seen").alias("seen"),
        F.sum("official").alias("official"),
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sum_cols))],
        *[F.max(f"o{i}").alias(f"o{i}") for i in range(len(sum_cols))],
        *[F.max(f"k{i}").alias(f"k{i}") for i in range(len(keep_cols))],
    )
    found = found.where(q("id").isNotNull() | (q("key").isNotNull() & (q("seen") > 0) & (q("official") > 0)))
    one = F.when(q("official") > 1, F.raise_error(F.lit(f"two official rows for one {key}")).cast("string")).otherwise(q("region"))
    own = q("id").isNotNull()
    sums = [
        F.when(own, q(f"s{i}")).when(q("part") > 0, F.coalesce(q(f"s{i}"), F.lit(0))).otherwise(q(f"o{i}")).alias(c) for i, c in enumerate(sum_cols)
    ]
    return found.select(q("key").alias(key), one.alias(region), *sums, *[q(f"k{i}").alias(c) for i, c in enumerate(keep_cols)])


def fill_from_row(df: DataFrame, *, keys: Sequence[str], flag, cols: Sequence[str]) -> DataFrame:
    """Fill missing values from the flagged row of the same key, in one pass: a key has a handful of categories."""
    group = W.partitionBy(*qs(keys))
    marked = F.coalesce(flag, F.lit(False))
    return df.withColumns({c: F.coalesce(q(c), F.max(F.when(marked, q(c))).over(group)) for c in cols}).select(*qs(df.columns))
