"""Ordered operators on series: positions, interpolation, lags, rolling means.

A panel holds at most one row per key and calendar step, so a series is as long as its calendar and one window
partition per key is small however large the table is; all columns share that one shuffle and sort.

Series without such a bound (event-level rows, or the whole frame taken as one series) are worked on in cells. Bounds
drawn from the ordered rows, about one for every `cell_rows` of them, cut the rows in the order of (keys, order), so
they cut a series wherever it is long, also within a day that holds nearly all of it. Rows are shuffled by cell; each
cell gives one row of summary. Summaries are scanned in groups of fixed size and the groups above them, and what a cell
needs from its series (row offset, nearest known values, last k values) is joined back. No task holds more than a cell
or a group of summaries, no window runs without a partition, and the result is that of one window over the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from growthlens.operators.common import as_list, key_struct, q, qs

_START = W.unboundedPreceding

#: Rows wanted in a cell. Bounds travel with the plan, so raise it for tables beyond some 10^11 rows.
CELL_ROWS = 1 << 20
#: Rows drawn for each bound: more of them make cells more even.
_DRAWN = 16
#: Cells, or groups of them, that one window scans, and cells that a series can have, as powers of two.
_GROUP_BITS, _NUMBER_BITS = 16, 31

# Keys and number of a row's cell as one struct. It is never NULL even if a key is, so windows, the summary and the join
# back all use the same hash partitioning. The keys travel inside it only, which lets the rows and their summary read
# one and the same exchange.
_CELL = "__cell"


def _bounds(df, keys, order, cell_rows):
    """One value: the drawn bounds in order, in runs of about the root of their number, each with its first.

    Rows are drawn by a hash of what they are ordered by, so the bounds depend on the data alone: the plan may be run
    again, in parts or with other partitions, and cells stay the same.
    """
    place = F.struct(key_struct(keys).alias("k"), *[q(o).alias(f"o{i}") for i, o in enumerate(order)])
    drawn = df.select(place.alias("p")).where(F.pmod(F.xxhash64("p"), F.lit(cell_rows)) < _DRAWN)
    listed = drawn.agg(F.sort_array(F.collect_list("p")).alias("p"))
    count = F.floor(F.size("p") / _DRAWN).cast("int")
    some = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    listed = listed.select(F.transform(some, lambda i: F.element_at("p", i * _DRAWN)).alias("b"))
    run = F.ceil(F.sqrt(F.size("b"))).cast("int")
    starts = F.when(F.size("b") > 0, F.sequence(F.lit(1), F.size("b"), F.greatest(run, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return place, listed.select(F.transform(starts, lambda i: F.struct(F.element_at("b", i).alias("first"), F.slice("b", i, run).alias("all"))).alias("runs")).scalar()


def _celled(df, keys, order, cell_rows=None):
    place, runs = _bounds(df, keys, order, cell_rows or CELL_ROWS)
    rows = df.withColumns({"__place": place, "__runs": runs})
    run = F.size(F.filter("__runs", lambda x: x["first"] <= q("__place")))
    within = lambda: F.size(F.filter(F.element_at("__runs", q("__run"))["all"], lambda x: x <= q("__place")))
    number = F.when(q("__run") > 0, (q("__run") - 1) * F.size(q("__runs")[0]["all"]) + within()).otherwise(0)
    cell = F.struct(*[q(k).alias(f"k{i}") for i, k in enumerate(keys)], number.alias("n"))
    rows = rows.withColumn("__run", run).withColumn(_CELL, cell)
    return rows.drop("__place", "__runs", "__run", *keys)


def _restored(columns, keys):
    inside = {k: q(_CELL)[f"k{i}"].alias(k) for i, k in enumerate(keys)}
    return [inside.get(c, q(c)) for c in columns]


def _asc(keys, order):
    return W.partitionBy(*qs(keys)).orderBy(*qs(order))


def _desc(keys, order):
    return W.partitionBy(*qs(keys)).orderBy(*[q(o).desc() for o in order])


class _Earlier:
    """What earlier cells of a series hand on: a sum, the last known value, or the last k values of arrays.

    `later` reads the series backwards. A carry can be read over the cells of a group, summed up for a whole group, and
    put together from the two.
    """

    def __init__(self, kind: str, column: str, *, later: bool = False, k: int = 0):
        self.kind, self.column, self.later, self.k = kind, column, later, k

    def over(self, column, of, at):
        """Of the cells, or groups, before this one within its window partition."""
        w = (W.partitionBy(of).orderBy(q(at).desc()) if self.later else W.partitionBy(of).orderBy(at)).rowsBetween(_START, -1)
        if self.kind == "sum":
            return F.sum(q(column)).over(w)
        if self.kind == "known":
            return F.last(q(column), ignorenulls=True).over(w)
        # k cells of at least one row each always hold the k rows wanted
        return self._newest(F.flatten(F.collect_list(q(column)).over(w.rowsBetween(-self.k, -1))))

    def total(self, column, at):
        """Of a whole group, as a group at the next level hands it on."""
        if self.kind == "sum":
            return F.sum(q(column))
        if self.kind == "known":
            found = F.when(q(column).isNotNull(), F.struct(q(at).alias("at"), q(column).alias("x")))
            return (F.min(found) if self.later else F.max(found))["x"]
        cells = F.sort_array(F.collect_list(F.struct(q(at).alias("at"), q(column).alias("x"))))
        return self._newest(F.flatten(F.transform(cells, lambda c: c["x"])))

    def merged(self, near, far):
        if self.kind == "sum":
            return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
        if self.kind == "known":
            return F.coalesce(near, far)
        empty = F.slice(near, 1, 0)
        return self._newest(F.concat(F.coalesce(far, empty), near))

    def _newest(self, values):
        return F.slice(values, F.greatest(F.size(values) - self.k + 1, F.lit(1)), self.k)


def _handed_on(cells, carries):
    """The cell table with one more column per carry: cells are scanned in groups, groups in groups of their own, up to
    one group for each series."""
    keys = [x for x in cells.schema[_CELL].dataType.names if x != "n"]
    series = F.struct(*[q(_CELL)[k].alias(k) for k in keys], F.lit(0).alias("none"))
    cells = cells.withColumns({"__series": series, "__at": q(_CELL)["n"]})
    return _scanned(cells, carries, {n: c.column for n, c in carries.items()}, _NUMBER_BITS).drop("__series", "__at")


def _scanned(table, carries, columns, bits):
    if bits <= _GROUP_BITS:
        return table.withColumns({n: c.over(columns[n], "__series", "__at") for n, c in carries.items()})
    group = F.struct("__series", F.shiftright("__at", _GROUP_BITS).alias("at"))
    table = table.withColumn("__group", group)
    table = table.withColumns({f"__near_{n}": c.over(columns[n], "__group", "__at") for n, c in carries.items()})
    totals = {n: f"__all_{n}" for n in carries}
    groups = table.groupBy("__group").agg(*[c.total(columns[n], "__at").alias(totals[n]) for n, c in carries.items()])
    groups = groups.withColumns({"__series": q("__group")["__series"], "__at": q("__group")["at"]}).withColumnRenamed("__group", "__of")
    far = {n: q(n).alias(f"__far_{n}") for n in carries}
    groups = _scanned(groups, carries, totals, bits - _GROUP_BITS).select(q("__of").alias("__group"), *far.values())
    table = table.join(groups, "__group", "left")
    table = table.withColumns({n: c.merged(q(f"__near_{n}"), q(f"__far_{n}")) for n, c in carries.items()})
    return table.drop("__group", *[f"__{x}_{n}" for n in carries for x in ("near", "far")])


def position(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str | Sequence[str],
    block_by: str | Sequence[str] | None = None,
    out: str = "position",
    total: str | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """1-based place of a row in its series, and optionally the length of the series.

    With `block_by`, columns that rise with the order (may be the order's own), a series may be of any length; it is
    worked on in cells of about `cell_rows` rows.
    """
    keys, order, celled = _scope(keys, order, "group", block_by)
    if not celled:
        df = df.withColumn(out, F.row_number().over(_asc(keys, order)).cast("long"))
        return df.withColumn(total, F.count("*").over(W.partitionBy(*qs(keys)))) if total else df
    rows = _celled(df, keys, order, cell_rows)
    sizes = rows.groupBy(_CELL).agg(F.count("*").alias("__size"))
    carries = {"__base": _Earlier("sum", "__size")} | ({"__rest": _Earlier("sum", "__size", later=True)} if total else {})
    sizes = _handed_on(sizes, carries)
    if total:
        sizes = sizes.withColumn(total, q("__base") + q("__size") + q("__rest"))
    added = [q(total)] if total else []
    sizes = sizes.select(_CELL, "__base", *added)
    rows = rows.withColumn("__r", F.row_number().over(_asc([_CELL], order))).join(sizes, _CELL, "left")
    return rows.select(*_restored(df.columns, keys), (q("__base") + q("__r")).alias(out), *added)


def interpolate(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    order: str | Sequence[str],
    cols: Sequence[str],
    direction: str = "forward",
    scope: str = "group",
    block_by: str | Sequence[str] | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """Linear interpolation with equal spacing by row.

    Missing values after the last known one repeat it. Missing values before the first known one stay missing with
    direction `forward` and take it with `both`. Scope `frame` treats the whole frame, in `order`, as one series.
    `block_by` and `cell_rows` as in `position`.
    """
    if direction not in ("forward", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    keys, order, celled = _scope(keys, order, scope, block_by)
    if celled:
        rows = _nearest_in_cells(df, keys, order, cols, cell_rows)
    else:
        rows = df.withColumn("__n", F.row_number().over(_asc(keys, order)))
        rows = _nearest(rows, keys, order, cols)
    filled = {}
    for i, c in enumerate(cols):
        prev, nxt = q(f"__p{i}"), q(f"__x{i}")
        step = (nxt["v"] - prev["v"]) * (q("__n") - prev["n"]) / (nxt["n"] - prev["n"])
        value = F.coalesce(q(c).cast("double"), prev["v"] + step, prev["v"])
        filled[c] = F.coalesce(value, nxt["v"]) if direction == "both" else value
    return rows.withColumns(filled).select(*(_restored(df.columns, keys) if celled else qs(df.columns)))


def _known(i: int, c: str, n: Column) -> Column:
    return F.when(q(c).isNotNull(), F.struct(n.alias("n"), q(c).cast("double").alias("v")))


def _nearest(rows, keys, order, cols):
    """Nearest known (place, value) at or before and at or after each row.

    Looking ahead is a descending running window: a frame that ends at the last row would be rescanned per row.
    """
    up = _asc(keys, order).rowsBetween(_START, 0)
    down = _desc(keys, order).rowsBetween(_START, 0)
    known = {f"__v{i}": _known(i, c, q("__n")) for i, c in enumerate(cols)}
    rows = rows.withColumns(known)
    rows = rows.withColumns({f"__p{i}": F.last(q(f"__v{i}"), ignorenulls=True).over(up) for i in range(len(cols))})
    return rows.withColumns({f"__x{i}": F.last(q(f"__v{i}"), ignorenulls=True).over(down) for i in range(len(cols))})


def _nearest_in_cells(df, keys, order, cols, cell_rows):
    rows = _celled(df, keys, order, cell_rows)
    rows = rows.withColumn("__r", F.row_number().over(_asc([_CELL], order)).cast("long"))
    marks = rows.withColumns({f"__v{i}": _known(i, c, q("__r")) for i, c in enumerate(cols)})
    edges = [f(q(f"__v{i}")).alias(f"__{n}{i}") for i in range(len(cols)) for n, f in (("f", F.min), ("l", F.max))]
    summary = marks.groupBy(_CELL).agg(F.count("*").alias("__size"), *edges)
    summary = _handed_on(summary, {"__base": _Earlier("sum", "__size")})
    shifted = {
        f"__{n}{i}": F.when(
            q(f"__{n}{i}").isNotNull(),
            F.struct((q("__base") + q(f"__{n}{i}")["n"]).alias("n"), q(f"__{n}{i}")["v"].alias("v")),
        )
        for i in range(len(cols))
        for n in "fl"
    }
    carry = {f"__cp{i}": _Earlier("known", f"__l{i}") for i in range(len(cols))}
    carry |= {f"__cx{i}": _Earlier("known", f"__f{i}", later=True) for i in range(len(cols))}
    summary = _handed_on(summary.withColumns(shifted), carry).select(*qs([_CELL, "__base", *carry]))

    rows = rows.join(summary, _CELL, "left").withColumn("__n", q("__base") + q("__r"))
    rows = _nearest(rows, [_CELL], order, cols)
    near = {f"__p{i}": F.coalesce(q(f"__p{i}"), q(f"__cp{i}")) for i in range(len(cols))}
    near |= {f"__x{i}": F.coalesce(q(f"__x{i}"), q(f"__cx{i}")) for i in range(len(cols))}
    return rows.withColumns(near)


def lags(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    order: str | Sequence[str],
    cols: Sequence[str],
    ks: Sequence[int],
    scope: str = "group",
    block_by: str | Sequence[str] | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """Add `<col>_lag_<k>`: the value k rows earlier in the series."""
    return lags_and_means(df, keys=keys, order=order, cols=cols, ks=ks, scope=scope, block_by=block_by, cell_rows=cell_rows)


def rolling_mean(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    order: str | Sequence[str],
    cols: Sequence[str],
    n: int,
    scope: str = "group",
    block_by: str | Sequence[str] | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """Add `<col>_rolling_mean_<n>`: mean of the last n rows, NULL unless all n are known."""
    return lags_and_means(df, keys=keys, order=order, cols=cols, ns=[n], scope=scope, block_by=block_by, cell_rows=cell_rows)


def lags_and_means(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    order: str | Sequence[str],
    cols: Sequence[str],
    ks: Sequence[int] = (),
    ns: Sequence[int] = (),
    scope: str = "group",
    block_by: str | Sequence[str] | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """Lags by every k of `ks` and means over every n of `ns` in one shuffle and sort; see `lags`, `rolling_mean`.

    `scope`, `block_by` and `cell_rows` as in `interpolate`.
    """
    keys, order, celled = _scope(keys, order, scope, block_by)
    if not celled:
        w = _asc(keys, order)
        out = {f"{c}_lag_{k}": F.lag(q(c), k).over(w) for c in cols for k in ks}
        for n in ns:
            frame = w.rowsBetween(-(n - 1), 0)
            out |= {f"{c}_rolling_mean_{n}": F.when(F.count(q(c)).over(frame) == n, F.avg(q(c)).over(frame)) for c in cols}
        return df.withColumns(out)
    w = _asc([_CELL], order)
    rows = _with_carried_values(df, keys, order, cols, max([*ks, *[n - 1 for n in ns]]), cell_rows)
    out = {}
    for i, c in enumerate(cols):
        for k in ks:
            carried = F.try_element_at(q(f"__tail{i}"), (q("__r") - F.lit(k + 1)).cast("int"))["v"]
            out[f"{c}_lag_{k}"] = F.when(q("__r") > k, F.lag(q(c), k).over(w)).otherwise(carried)
        for n in ns:
            frame = w.rowsBetween(-(n - 1), 0)
            tail = F.when(q("__r") < n, F.coalesce(q(f"__tail{i}"), F.array().cast("array<struct<v:double>>")))
            need = F.lit(n) - q("__r")
            held = F.slice(tail, F.greatest(F.size(tail) - need + 1, F.lit(1)).cast("int"), n)
            held_sum = F.aggregate(held, F.lit(0.0), lambda s, x: s + F.coalesce(x["v"], F.lit(0.0)))
            held_known = F.size(F.filter(held, lambda x: x["v"].isNotNull()))
            known = F.count(q(c)).over(frame) + F.when(q("__r") < n, held_known).otherwise(0)
            total = F.coalesce(F.sum(q(c).cast("double")).over(frame), F.lit(0.0))
            total = total + F.when(q("__r") < n, held_sum).otherwise(0.0)
            out[f"{c}_rolling_mean_{n}"] = F.when(known == n, total / F.lit(n))
    return rows.withColumns(out).select(*_restored(df.columns, keys), *qs(list(out)))


def _with_carried_values(df, keys, order, cols, k, cell_rows):
    """Rows with their place in the cell and, per column, the last k values of the cells before it."""
    celled = _celled(df, keys, order, cell_rows)
    rows = celled.withColumn("__r", F.row_number().over(_asc([_CELL], order)))
    last = celled.withColumn("__back", F.row_number().over(_desc([_CELL], order))).where(q("__back") <= k)
    values = [q(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]
    kept = F.sort_array(F.collect_list(F.struct((-q("__back")).alias("back"), *values)))
    tails = _handed_on(last.groupBy(_CELL).agg(kept.alias("__kept")), {"__newest": _Earlier("tail", "__kept", k=k)})
    split = {f"__tail{i}": F.transform("__newest", _pick(i)) for i in range(len(cols))}
    return rows.join(tails.withColumns(split).select(*qs([_CELL, *split])), _CELL, "left")


def _pick(i: int):
    return lambda x: F.struct(x[f"v{i}"].alias("v"))


def _scope(keys, order, scope, block_by):
    """Keys, the full order, and whether the series may be of any length."""
    order = as_list(order)
    if scope not in ("group", "frame"):
        raise ValueError(f"unknown scope {scope!r}")
    keys = list(keys) if scope == "group" else []
    leading = as_list(block_by) if block_by is not None else []
    order = [o for o in dict.fromkeys([*leading, *order]) if o not in keys]
    return keys, order, block_by is not None or scope == "frame"
