"""Quality reports, exact quantiles, outlier screens, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from growthlens.operators.common import join_back, q, qs, with_stats
from growthlens.operators.project import numeric_cols

# Relative rank error of approx_percentile is 1 / accuracy; brackets are taken several errors wide.
_ACCURACY = 10_000
_MARGIN = 4.0 / _ACCURACY
_BINS = 1000


def quantiles(
    df: DataFrame, *, keys: Sequence[str], col: str, probs: Sequence[float], names: Sequence[str], bounded: bool = False
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key: keys, `n` (known values), one column per prob.

    `percentile` keeps every distinct value of a group in one task's memory; that is used only with `bounded=True`,
    for groups whose size has a known limit; otherwise see `ranked`. A key without a known value has no row either way.
    """
    keys = list(keys)
    if bounded:
        v = q(col).cast("double")
        out = [F.percentile(v, F.lit(float(p))).alias(n) for p, n in zip(probs, names)]
        found = df.groupBy(*qs(keys)).agg(F.count(v).alias("n"), *out)
        return found.where("n > 0") if keys else found
    found = ranked(df, keys, [col], probs).where("n > 0")
    return found.select(*qs(keys), "n", *[q(f"p{probs.index(p)}").alias(n) for p, n in zip(probs, names)])


def ranked(df, keys, cols, probs, *, extra=None, distinct=False):
    """Exact quantiles of several columns in two scans: one row per key and column with `__column` (its number), `n`,
    `min`, `max`, `p0`, `p1`, ... for the probs, and `distinct` if asked for.

    The first scan gives each quantile a narrow bracket by a mergeable sketch, and whatever `extra` asks for (name ->
    function of a column). The second counts rows per cell: brackets are cut into bins, whose values are kept with their
    counts, and the gaps between brackets need theirs only; both come from one aggregation that combines before the
    shuffle. Counts give every cell its rank, and a rank is looked up in the values of its bin. No task holds a group,
    but the distinct values of a bin (about a millionth of a group) lie in one row. A bracket that misses its rank
    raises an error rather than a wrong value.
    """
    edges = sorted({e for p in probs for e in _bracket(p)})
    ordered = sorted(set(probs))
    doubles = df.select(*qs(keys), *[q(c).cast("double").alias(f"__v{i}") for i, c in enumerate(cols)])

    def sketched(i):
        v = q(f"__v{i}")
        brackets = F.approx_percentile(v, F.array(*[F.lit(e) for e in edges]), F.lit(_ACCURACY))
        return F.struct(F.count(v).alias("n"), brackets.alias("e"), *[f(v).alias(n) for n, f in (extra or {}).items()])

    sketches = F.array(*[sketched(i) for i in range(len(cols))])
    if keys:
        rows = join_back(doubles, doubles.groupBy(*qs(keys)).agg(sketches.alias("__s")), keys)
    else:
        whole = doubles.agg(sketches.alias("__s")).scalar()
        rows = doubles.withColumn("__s", whole)
    series = F.struct(*[q(k).alias(f"k{j}") for j, k in enumerate(keys)])
    # one row for each value before anything is worked out, so that the generated code stays small
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), q(f"__v{i}").alias("v")) for i in range(len(cols))]))
    rows = rows.select(series.alias("series"), "__s", each).withColumns({"e": q("__s")[q("c")]["e"], "n": q("__s")[q("c")]["n"]})
    lo, hi = (F.array(*[F.get("e", F.lit(edges.index(_bracket(p)[side]))) for p in ordered]) for side in (0, 1))
    rows = rows.select(F.struct("c", "series").alias("of"), "v", "n", lo.alias("lo"), hi.alias("hi"))
    # Cells rise with the value: the gap below bracket g has bin -1, the bracket itself bins 0 and up.
    gap = reduce(add, [(q("v") > q("hi")[i]).cast("int") for i in range(len(ordered))])
    rows = rows.select("of", "v", "n", F.coalesce(gap, F.lit(-1)).alias("gap"), F.get("lo", gap).alias("floor"), F.get("hi", gap).alias("ceiling"))
    share = F.coalesce(F.try_divide(q("v") - q("floor"), q("ceiling") - q("floor")), F.lit(0.0))
    inside = (q("v") >= q("floor")) & (q("v") <= q("ceiling"))
    bin_ = F.when(q("v").isNull(), F.lit(-2)).when(inside, F.least(F.floor(share * _BINS), F.lit(_BINS - 1)).cast("int")).otherwise(F.lit(-1))
    rows = rows.select("of", "gap", bin_.alias("bin"), "v", "n", (q("v") if distinct else F.when(inside, q("v"))).alias("in"))
    cell = ["of", "gap", "bin"]
    values = rows.groupBy(*cell, "in").agg(F.count("v").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), F.max("n").alias("n"))
    cells = values.groupBy(*cell).agg(
        F.sum("c").alias("m"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.max("n").alias("known"),
        F.count("in").alias("distinct"),
        F.collect_list(F.when(q("bin") >= 0, F.struct(q("in").alias("v"), "c"))).alias("values"),
    )
    before = W.partitionBy("of").orderBy("gap", "bin").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0)))

    def at(rank):
        # Between the brackets only the first and the last value of a gap are known.
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))

        def step(found, x):
            seen = found["seen"] + x["c"]
            return F.struct(seen.alias("seen"), F.when(found["v"].isNull() & (rank - q("base") < seen), x["v"]).otherwise(found["v"]).alias("v"))

        known = (
            F.when(q("bin") >= 0, F.aggregate(F.sort_array("values"), start, step)["v"])
            .when(rank == q("base"), q("least"))
            .when(rank == q("base") + q("m") - 1, q("most"))
            .otherwise(F.raise_error(F.lit("quantiles: bracket missed the rank")).cast("double"))
        )
        return F.max(F.when((q("base") <= rank) & (rank < q("base") + q("m")), known))

    out = [F.max("known").alias("n"), F.min("least").alias("min"), F.max("most").alias("max")]
    out += [F.sum("distinct").alias("distinct")] if distinct else []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (q("known") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        out.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(f"p{i}"))
    found = cells.groupBy("of").agg(*out)
    found = found.select(*[q("of")["series"][f"k{j}"].alias(k) for j, k in enumerate(keys)], q("of")["c"].alias("__column"), *qs(found.columns[1:]))
    if extra is None:
        return found
    # the same one-row subquery as above, which Spark runs once
    facts = df.sparkSession.range(1).select(F.posexplode(whole).alias("__column", "__s"))
    return facts.select("__column", *[q("__s")[n].alias(n) for n in extra]).join(found, "__column", "left")


def _bracket(p: float) -> tuple[float, float]:
    return max(0.0, p - _MARGIN), min(1.0, p + _MARGIN)


def iqr_filter(
    df: DataFrame, *, keys: Sequence[str], col: str, k: float = 1.5, action: str = "drop", bounded: bool = False
) -> DataFrame:
    """Interquartile fence per series, bounds inclusive.

    drop: rows outside the fence, and rows with a missing value, are removed. flag: adds `outlier` (missing values are
    no outliers).
    """
    names = ["__q1", "__q3"]
    fence = quantiles(df, keys=keys, col=col, probs=[0.25, 0.75], names=names, bounded=bounded).drop("n")
    if keys:
        rows = join_back(df, fence, keys)
    else:
        rows = df.withColumn("__f", fence.select(F.struct(*qs(names))).scalar())
        rows = rows.withColumns({n: q("__f")[n] for n in names}).drop("__f")
    spread = q("__q3") - q("__q1")
    ok = q(col).between(q("__q1") - F.lit(k) * spread, q("__q3") + F.lit(k) * spread)
    if action == "drop":
        return rows.where(ok).select(*qs(df.columns))
    if action == "flag":
        return rows.withColumn("outlier", F.coalesce(~ok, F.lit(False))).select(*qs(df.columns), "outlier")
    raise ValueError(f"unknown action {action!r}")


def zscore(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = (), threshold: float = 3.0) -> DataFrame:
    """Add `<col>_zscore` (sample deviation) and `<col>_outlier` for |z| above the threshold."""
    stats = {}
    for i, c in enumerate(cols):
        stats |= {f"__m{i}": F.avg(q(c)), f"__d{i}": F.stddev_samp(q(c))}
    rows = with_stats(df, keys, stats)
    for i, c in enumerate(cols):
        rows = rows.withColumn(f"{c}_zscore", F.try_divide(q(c) - q(f"__m{i}"), q(f"__d{i}")))
        rows = rows.withColumn(f"{c}_outlier", F.coalesce(F.abs(q(f"{c}_zscore")) > threshold, F.lit(False)))
    return rows.drop(*stats)


def null_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, their number and percentage, most affected first."""
    counts = [F.count_if(q(c).isNull()).alias(c) for c in df.columns]
    one = df.agg(F.count("*").alias("__rows"), *counts)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), q(c).alias("missing")) for c in df.columns])
    long = one.select("__rows", F.explode(pairs).alias("p")).where(q("p")["missing"] > 0)
    out = long.select(
        q("p")["column"].alias("column"),
        q("p")["missing"].alias("missing"),
        (q("p")["missing"] * 100.0 / q("__rows")).alias("missing_pct"),
    )
    return out.orderBy(F.desc("missing"), "column")


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, std, min, quartiles, max and the exact number of distinct values."""
    cols = list(cols or numeric_cols(df))
    extra = {"count": F.count, "mean": F.avg, "std": F.stddev_samp}
    found = ranked(df, [], cols, [0.25, 0.5, 0.75], extra=extra, distinct=True)
    name = F.array(*[F.lit(c) for c in cols])[q("__column")]
    quart = [q(f"p{i}").alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return found.select(name.alias("column"), "count", "mean", "std", "min", "max", F.coalesce("distinct", F.lit(0)).alias("distinct"), *quart)


def distribution(
    df: DataFrame, *, keys: Sequence[str], col: str, probs: Sequence[float] = (0.25, 0.5, 0.75), bounded: bool = False
) -> DataFrame:
    """Minimum, quantiles and maximum per key: the numbers behind a box or violin plot."""
    names = [f"q{round(p * 100)}" for p in probs]
    kind = df.schema[col].dataType
    if bounded:
        parts = [F.percentile(q(col).cast("double"), F.lit(float(p))).alias(n) for p, n in zip(probs, names)]
        return df.groupBy(*qs(keys)).agg(F.min(q(col)).alias("min"), F.max(q(col)).alias("max"), F.nullif(F.count(q(col)), F.lit(0)).alias("n"), *parts)
    quart = [q(f"p{i}").alias(n) for i, n in enumerate(names)]
    found = ranked(df, list(keys), [col], list(probs))
    return found.select(*qs(keys), q("min").cast(kind).alias("min"), q("max").cast(kind).alias("max"), F.nullif("n", F.lit(0)).alias("n"), *quart)


def correlation(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r of every pair of columns (a before b), rows with a missing value skipped pair by pair."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]

    def r(a: str, b: str):
        both = q(a).isNotNull() & q(b).isNotNull()
        return F.corr(F.when(both, q(a).cast("double")), F.when(both, q(b).cast("double")))

    wide = df.groupBy(*qs(keys)).agg(*[r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), q(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(*qs(keys), F.inline(rows))
