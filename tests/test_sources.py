import pytest

from pyspark.sql import Observation

from growthlens.sources import corrupt_rows, file_headers, load_folder, read_sheet, read_table, read_tables, run_report, with_name_part, write_table
from growthlens.sources.files import ORDINAL


def put(folder, name, text, encoding="utf-8"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder)


def test_read_table_with_bom_quotes_and_source(spark, tmp_path):
    path = put(tmp_path / "in", "a b.csv", '﻿"REF_DATE","GEO","VALUE"\n"2016/2017","Ontario","82"\n"2017/2018","Quebec, East",""\n')
    df = read_table(spark, path, "REF_DATE string, GEO string, VALUE double", with_source=True, with_ordinal=True)
    rows = df.orderBy(*ORDINAL).collect()
    assert [(r.REF_DATE, r.GEO, r.VALUE) for r in rows] == [("2016/2017", "Ontario", 82.0), ("2017/2018", "Quebec, East", None)]
    assert with_name_part(df, r"^(.*)\.csv$", "name").first()["name"] == "a b"


def test_bad_rows_are_skipped_counted_or_fatal(spark, tmp_path):
    path = put(tmp_path / "in", "x.csv", "k,v\n1,2.0\n2,--\n3,4.0\n")
    schema = "k int, v double"
    seen = Observation()
    assert sorted(r.k for r in read_table(spark, path, schema, on_bad="skip", observed=seen).collect()) == [1, 3]
    assert seen.get == {"rows": 3, "bad_rows": 1}
    some = read_table(spark, path, schema, on_bad="skip", observed=Observation()).select("k")
    assert [r.k for r in some.orderBy("k").collect()] == [1, 3]
    with pytest.raises(ValueError, match="Observation"):
        read_table(spark, path, schema, on_bad="skip")
    report = corrupt_rows(spark, path, schema).first()
    assert (report["rows"], report["bad_rows"]) == (3, 1)
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        read_table(spark, path, schema).collect()
    with pytest.raises(ValueError):
        read_table(spark, path, schema, on_bad="guess")


def test_a_different_header_is_an_error(spark, tmp_path):
    path = put(tmp_path / "in", "x.csv", "v,k\n1,2\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|header"):
        read_table(spark, path, "k int, v int", on_bad="fail").collect()


def test_read_tables_lines_columns_up_by_name(spark, tmp_path):
    put(tmp_path / "in", "a (1).csv", "Year,n\n2000,1\n2001,2\n")
    path = put(tmp_path / "in", "b+c.csv", "n,Year,extra\n3,2002,x\n")
    df = read_tables(spark, path, with_source=True)
    rows = {r.Year: (r.n, r.extra, r.source_file) for r in with_name_part(df, "(.*)", "source_file").collect()}
    assert rows == {"2000": ("1", None, "a (1).csv"), "2001": ("2", None, "a (1).csv"), "2002": ("3", "x", "b+c.csv")}
    ordered = read_tables(spark, path, with_ordinal=True).where("extra is null").orderBy(*ORDINAL)
    assert [r.n for r in ordered.collect()] == ["1", "2"]


SHEET = """"Households (000's), © agency",,,
Scenario,Growth,,
,Year,High,Low,
Estimates,2000,10,,
,2005,"1,020",,
High,2010,30,29,
Medium,2010,28,27,
,2015,31,
,,,,
Source: agency,,,
"""


def test_read_sheet_carries_labels(spark, tmp_path):
    path = put(tmp_path / "s", "sheet(X).csv", SHEET, "latin-1")
    df = read_sheet(spark, path, columns={"Year": 1, "high": 2}, skip=2, label_col=0, keep_labels=["Estimates", "Medium"])
    rows = [(r.label, r.Year, r.high) for r in df.orderBy("line").collect()]
    assert rows == [("Estimates", "2000", "10"), ("Estimates", "2005", "1,020"), ("Medium", "2010", "28"), ("Medium", "2015", "31")]
    plain = read_sheet(spark, path, columns={"first": 0}, skip=0)
    assert plain.orderBy("line").first()["first"] == "Households (000's), © agency"


def test_write_and_report(spark, tmp_path, frame):
    df = frame([(1, "a"), (2, "b")], "k int, `a name` string")
    p, c = str(tmp_path / "deep" / "p"), str(tmp_path / "c")
    write_table(df, p)
    write_table(df, p)
    write_table(df, c, fmt="csv")
    assert spark.read.parquet(p).count() == 2
    assert spark.read.csv(c, header=True).columns == ["k", "a name"]
    write_table(df, str(tmp_path / "by"), partition_by=["k"])
    assert (tmp_path / "by" / "k=1").exists()
    report = {r.output: (r.rows, r.status) for r in run_report(spark, ["p", "none"], {"p": (p, write_table(df, p))}).collect()}
    assert report == {"p": (2, "generated"), "none": (None, "not generated")}


def test_headers_are_read_no_further_than_the_first_line(spark, tmp_path):
    """Files of many splits: the catalogue opens each once, and the rows come from one scan."""
    body = "".join(f"{i},x{i}\n" for i in range(40_000))
    put(tmp_path / "in", "long.csv", "Year,n\n" + body)
    put(tmp_path / "in", "other.csv", "n,Year,m\n" + "".join(f"y{i},{i},1\n" for i in range(1000)))
    path = put(tmp_path / "in", "one.csv", "Year,n\n7,z")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64 << 10)
    try:
        assert {r.file.split("/")[-1]: r.header for r in file_headers(spark, path).collect()} == {
            "long.csv": "Year,n", "other.csv": "n,Year,m", "one.csv": "Year,n"}
        df = read_tables(spark, path, with_source=True)
        assert df.rdd.getNumPartitions() > 5
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("FileScan csv") == 1 and "FileScan text" not in plan
        counts = {(r.source_file, r.m): r["count"] for r in df.groupBy("source_file", "m").count().collect()}
        assert counts == {("long.csv", None): 40_000, ("other.csv", "1"): 1000, ("one.csv", None): 1}
        assert df.where("n = 'y17'").first().Year == "17" and df.where("n = 'x39999'").first().Year == "39999"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_odd_headers(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", '﻿"a, b",,x,x, \r\n1,2,3,4,5\r\n')
    put(tmp_path / "in", "empty.csv", "")
    df = read_tables(spark, path)
    assert df.columns == ["a, b", "_c1", "x2", "x3"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3", "4")]
    with pytest.raises(FileNotFoundError):
        read_tables(spark, put(tmp_path / "none", "empty.csv", ""))


def test_bad_files_are_listed_and_skipped(spark, tmp_path):
    import gzip

    schema = "k int, v double"
    put(tmp_path / "in", "good.csv", "k,v\n1,2.0\n2,--\n3,4.0\n")
    put(tmp_path / "in", "other.csv", "k,w\n9,9.0\n")
    whole = gzip.compress(b"k,v\n" + b"".join(b"%d,%d.5\n" % (i, i * 7919 % 1013) for i in range(60_000)))
    path = put(tmp_path / "in", "z z.csv", "k,v\n8,8.0\n")
    (tmp_path / "in" / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "in" / "noise.csv.gz").write_bytes(b"no gzip at all")
    rows, report = load_folder(spark, path, schema)
    assert sorted((r.k, r.v, r.source_file) for r in rows.collect()) == [(1, 2.0, "good.csv"), (3, 4.0, "good.csv"), (8, 8.0, "z z.csv")]
    got = {r.source_file: (r.rows, r.bad_rows, r.reason) for r in report.collect()}
    assert got["good.csv"] == (3, 1, None) and got["z z.csv"] == (1, 0, None) and got["other.csv"] == (0, 0, "header: k,w")
    assert got["cut.csv.gz"][:2] == (0, 0) and got["cut.csv.gz"][2].startswith("breaks off")
    assert got["noise.csv.gz"][:2] == (0, 0) and got["noise.csv.gz"][2]
    with pytest.raises(OSError, match="header: k,w"):
        load_folder(spark, put(tmp_path / "only", "x.csv", "k,w\n1,1\n"), schema)
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        load_folder(spark, path, schema, most_bad_files=0)


def test_files_that_cannot_be_opened(spark, tmp_path, caplog):
    path = put(tmp_path / "in", "a.csv", "k,v\n1,2\n")
    (tmp_path / "in" / "b.csv.gz").write_bytes(b"no gzip at all")
    with pytest.raises(OSError, match="b.csv.gz"):
        read_tables(spark, path)
    assert [tuple(r) for r in read_tables(spark, path, on_bad="skip").collect()] == [("1", "2")]
    assert "b.csv.gz skipped" in caplog.text
    (tmp_path / "in" / "a.csv").unlink()
    with pytest.raises(FileNotFoundError):
        read_tables(spark, path, on_bad="skip")
    with pytest.raises(ValueError):
        read_tables(spark, path, on_bad="guess")
