"""Pivots, joins, aggregates, filters."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from growthlens.operators.aggregates import bounds, keep_first, rollup, supply_demand
from growthlens.operators.common import with_stats
from growthlens.operators.joins import apply_aliases, fill_from_row, melt, melt_lookup, merge_features, patch_totals
from growthlens.operators.pivots import duplicate_cells, pivot_panel
from growthlens.operators.project import (
    drop_sparse,
    drop_value,
    every_nth,
    keep_range,
    keep_values,
    numeric_cols,
    require,
    scale,
    zeros_to_null,
)


@pytest.fixture
def long(frame):
    rows = [("a", 1, "x", None, 1), ("a", 1, "x", 5.0, 2), ("a", 1, "x", 7.0, 3), ("a", 1, "y", 2.0, 4),
            ("b", 1, "x", None, 5), ("b", 2, "z", 1.0, 6)]
    return frame(rows, "g string, t int, cat string, v double, n int")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_pivot_first_takes_earliest_known_value_and_keeps_every_key(long):
    out = pivot_panel(long, keys=["g", "t"], category="cat", values=["x", "y"], value="v", ordinal="n")
    assert rows(out, "g", "t") == [("a", 1, 5.0, 2.0), ("b", 1, None, None), ("b", 2, None, None)]


def test_pivot_mean_sum_and_absent_category(long):
    mean = pivot_panel(long, keys=["g"], category="cat", values={"x": "ex", "w": "none"}, value="v", how="mean")
    assert rows(mean, "g") == [("a", 6.0, None), ("b", None, None)]
    total = pivot_panel(long, keys=["g"], category="cat", values=["x"], value="v", how="sum")
    assert rows(total, "g") == [("a", 12.0), ("b", None)]


def test_pivot_strict_fails_on_duplicates_and_report_names_them(long):
    with pytest.raises(PySparkException, match="duplicate rows"):
        pivot_panel(long, keys=["g", "t"], category="cat", values=["x"], value="v", how="strict").collect()
    assert rows(duplicate_cells(long, keys=["g", "t"], category="cat")) == [("a", 1, "x", 3)]
    single = pivot_panel(long.where("n > 3"), keys=["g", "t"], category="cat", values=["x", "y"], value="v", how="strict")
    assert rows(single, "g", "t") == [("a", 1, None, 2.0), ("b", 1, None, None), ("b", 2, None, None)]


def test_pivot_is_one_shuffle(long):
    out = pivot_panel(long, keys=["g", "t"], category="cat", values=["x", "y"], value="v", ordinal="n")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.fixture
def tables(frame):
    return [frame([(1, 10.0), (2, 20.0)], "k int, a double"), frame([(2, 200.0), (3, 300.0)], "k int, b double"),
            frame([(3, "c")], "k int, c string")]


def test_merge_kinds(tables):
    assert rows(merge_features(tables, ["k"], "left"), "k") == [(1, 10.0, None, None), (2, 20.0, 200.0, None)]
    full = [(1, 10.0, None, None), (2, 20.0, 200.0, None), (3, None, 300.0, "c")]
    assert rows(merge_features(tables, ["k"], "full"), "k") == full
    assert rows(merge_features(tables[:2], ["k"], "inner"), "k") == [(2, 20.0, 200.0)]


def test_full_merge_does_not_depend_on_order(tables):
    names = ["k", "a", "b", "c"]
    want = rows(merge_features(tables, ["k"], "full").select(names), "k")
    assert rows(merge_features(tables[::-1], ["k"], "full").select(names), "k") == want


def test_full_merge_rejects_repeated_keys(tables):
    twice = tables[0].union(tables[0])
    with pytest.raises(PySparkException, match="twice"):
        merge_features([twice, tables[1]], ["k"], "full").collect()


def test_merge_clashes(frame):
    a = frame([(1, 1.0), (2, None)], "k int, v double")
    b = frame([(1, 5.0), (2, 6.0)], "k int, v double")
    with pytest.raises(ValueError):
        merge_features([a, b], ["k"], "full")
    suffix = merge_features([a, b], ["k"], "full", on_clash="suffix")
    assert suffix.columns == ["k", "v", "v_dup1"]
    for how in ("full", "left"):
        assert rows(merge_features([a, b], ["k"], how, on_clash="first"), "k") == [(1, 1.0), (2, None)]
        assert rows(merge_features([a, b], ["k"], how, on_clash="coalesce"), "k") == [(1, 1.0), (2, 6.0)]


def test_patch_totals(frame):
    panel = frame([(2000, "x", 1.0, 9.0), (2000, "y", None, 9.0), (2000, "All", 99.0, 9.0), (2001, "All", 5.0, 9.0),
                   (2002, "x", None, 9.0)], "y int, r string, p double, e double")
    official = frame([(2000, "All", 50.0, 100.0), (2001, "All", 51.0, 101.0), (2002, "All", 52.0, 102.0),
                      (1999, "All", 1.0, 1.0)], "y int, r string, p double, e double")
    out = patch_totals(panel, official, key="y", region="r", total_name="All", sum_cols=["p"], keep_cols=["e"])
    # 2001 has no parts, so the official value stays; 2002 has only missing parts, whose sum is 0; 1999 is not in the panel.
    assert [tuple(r) for r in out.where("r = 'All'").orderBy("y").collect()] == [
        (2000, "All", 1.0, 100.0), (2001, "All", 51.0, 101.0), (2002, "All", 0.0, 102.0)]
    assert out.where("r <> 'All'").count() == 3
    assert out.dtypes == panel.dtypes


def test_patch_totals_reads_each_input_once(spark, frame, tmp_path):
    frame([(2000, "x", 1.0, 9.0), (2000, "x", 1.0, 9.0), (None, "x", 2.0, 9.0)], "y int, r string, p double, e double").write.parquet(str(tmp_path / "p"))
    panel = spark.read.parquet(str(tmp_path / "p"))
    official = frame([(2000, "All", 50.0, 100.0), (None, "All", 50.0, 100.0)], "y int, r string, p double, e double")
    how = {"key": "y", "region": "r", "total_name": "All", "sum_cols": ["p"], "keep_cols": ["e"]}
    out = patch_totals(panel, official, **how)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    # rows that repeat are parts of their own; a missing year has no total
    got = sorted((str(r.y), r.r, r.p, r.e) for r in out.collect())
    assert got == [("2000", "All", 2.0, 100.0), ("2000", "x", 1.0, 9.0), ("2000", "x", 1.0, 9.0), ("None", "x", 2.0, 9.0)]
    with pytest.raises(Exception, match="two official rows"):
        patch_totals(panel, official.union(official), **how).collect()


def test_fill_from_row_melt_and_aliases(frame):
    df = frame([(1, "all", 5.0), (1, "kid", None), (1, "old", 2.0), (2, "kid", None)], "y int, c string, v double")
    filled = fill_from_row(df, keys=["y"], flag=F.col("c") == "all", cols=["v"])
    assert rows(filled, "y", "c") == [(1, "all", 5.0), (1, "kid", 5.0), (1, "old", 2.0), (2, "kid", None)]
    wide = frame([(1, 10, 11)], "y int, kid bigint, old bigint")
    assert rows(melt(wide, id="y", name_col="c", value_col="n"), "c") == [(1, "kid", 10), (1, "old", 11)]
    looked = melt_lookup(df, wide, id="y", name_col="c", value_col="n")
    assert {(r.y, r.c): r.n for r in looked.collect()} == {(1, "all"): None, (1, "kid"): 10, (1, "old"): 11, (2, "kid"): None}
    names = {"kid": "child", "old": "senior"}
    assert {r.c for r in apply_aliases(df, "c", names).collect()} == {"child", "senior"}
    table = frame(list(names.items()), "alias string, name string")
    assert {r.c for r in apply_aliases(df, "c", table).collect()} == {"child", "senior"}
    assert apply_aliases(df, "c", table, drop_unmapped=False).count() == 4


def test_aggregates(frame):
    df = frame([("a", 1, None), ("a", 2, 4.0), ("b", 1, None)], "g string, t int, v double")
    out = rollup(df, ["g"], {"s": ("sum", "v"), "m": ("avg", "v"), "n": ("count", "v")})
    assert rows(out, "g") == [("a", 4.0, 4.0, 1), ("b", 0.0, None, 0)]
    assert rows(keep_first(df, keys=["g"], order="t"), "g") == [("a", 1, None), ("b", 1, None)]
    b = df.select(bounds(df, "t").alias("b")).first()["b"]
    assert (b.lo, b.hi) == (1, 2)
    assert rows(with_stats(df, (), {"top": F.max("v")}).select("top")) == [(4.0,)] * 3
    sd = supply_demand(frame([("a", 10.0, 3.0), ("a", 20.0, 4.0)], "g string, d double, s double"), ["g"], demand="d", supply="s")
    assert rows(sd) == [("a", 15.0, 7.0, True)]


def test_filters_and_projections(frame):
    df = frame([("a", 1, 0.0), ("b", 2, 5.0), (None, 3, None)], "g string, t int, v double")
    assert keep_values(df, "g", ["a"]).count() == 1
    assert {r.t for r in drop_value(df, "g", "a").collect()} == {2, 3}
    assert {r.t for r in keep_range(df, "t", 1, 3, hi_inclusive=False).collect()} == {1, 2}
    assert {r.t for r in keep_range(df, "t", None, 2).collect()} == {1, 2}
    assert require(df, ["t", "g"]).columns == ["t", "g"]
    with pytest.raises(ValueError, match="missing required columns: w"):
        require(df, ["w"])
    assert numeric_cols(df, exclude=["t"]) == ["v"]
    assert [r.v for r in zeros_to_null(df, ["v"]).orderBy("t").collect()] == [None, 5.0, None]
    assert [r.v for r in scale(df, ["v"], 1000).orderBy("t").collect()] == [0.0, 5000.0, None]
    assert [r.t for r in every_nth(df, "t", 3, 2).collect()] == [2]
    wide = df.withColumn("rare", F.when(F.col("t") == 1, 1.0))
    assert drop_sparse(wide, 0.6).columns == ["g", "t", "v"]
    assert drop_sparse(wide, 0.7).columns == wide.columns


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) s", "id * 2 w").write.parquet(str(tmp_path / "t"))
    out = require(keep_range(spark.read.parquet(str(tmp_path / "t")), "id", 3, 5), ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3)" in plan and "ReadSchema: struct<id:bigint>" in plan
