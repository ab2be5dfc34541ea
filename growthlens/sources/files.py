"""CSV scans of single files and folders."""

from __future__ import annotations

import csv
import logging
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.session import materialised

log = logging.getLogger(__name__)

_CORRUPT = "_corrupt_record"
# Place of a row in the input: later columns break ties of earlier ones.
ORDINAL = ["__file", "__block", "__line"]


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType,
    *,
    with_source: bool = False,
    with_ordinal: bool = False,
    on_bad: str = "fail",
    observed: Observation | None = None,
) -> DataFrame:
    """CSV files that share one header.

    The header is checked against the schema, so a file with other columns is an error and never misread. Rows that do
    not fit the schema fail the job (`fail`) or are left out (`skip`); then `observed` must be given, and gets `rows` and
    `bad_rows` from the same scan once it has run (twice as many where a global sort reads it twice). `corrupt_rows` counts per file. Unreadable files always fail.
    `with_source` adds `source_file`; `with_ordinal` adds the columns in ORDINAL, which
    order rows as they stand in the input.
    """
    extra = _provenance(with_source, with_ordinal)
    if on_bad == "fail":
        fields = _fields(schema)
        df = spark.read.schema(fields).csv(path, header=True, enforceSchema=False, mode="FAILFAST", quote='"', escape='"')
        return df.select(*_names(fields), *extra)
    if on_bad != "skip":
        raise ValueError(f"unknown choice {on_bad!r}")
    if observed is None:
        raise ValueError("on_bad='skip' needs an Observation for the number of rows left out")
    df, good = _scan_text(spark, path, schema)
    typed = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in _fields(schema)]
    names = [f.name for f in _fields(schema)]
    marked = df.select("*", *extra, good.alias("__good"))
    marked = marked.observe(observed, F.count("*").alias("rows"), F.count_if(~F.col("__good")).alias("bad_rows"))
    kept = marked.where("__good").drop("__good")
    return kept.select(*typed, *[c for c in kept.columns if c not in names and c != _CORRUPT])


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, reason) of every file of a folder: its first line, or why it could not be read.

    The listing carries no content; tasks open the files dealt to them and read no further than the first line, through
    pyarrow's file systems. Compressed files are told by their name.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), plain_path(F.col("_metadata.file_path")).alias("uri"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_first_line(uri) for uri in batch.column("uri").to_pylist()]
            headers, reasons = [h for h, _ in found], [r for _, r in found]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(headers, pa.string()), pa.array(reasons, pa.string())], ["file", "header", "reason"])

    return listed.mapInArrow(run, "file string, header string, reason string")


def _first_line(uri: str) -> tuple[str | None, str | None]:
    try:
        if uri.startswith("file:"):
            system, place = fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        else:
            system, place = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
        line = b""
        with system.open_input_stream(place) as stream:
            while b"\n" not in line and (more := stream.read(1 << 12)):
                line += more
        return line.split(b"\n")[0].rstrip(b"\r").removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace"), None
    except Exception as e:  # any file may be broken in its own way; the reason is the result
        return None, f"{type(e).__name__}: {e}"[:500]


def _columns(header: str) -> list[str]:
    """Names of a header as the CSV reader makes them: empty ones by their place, repeated ones with it."""
    names = next(csv.reader([header]), [])
    often = Counter(names)
    return [f"_c{i}" if not n else f"{n}{i}" if often[n] > 1 else n for i, n in enumerate(names)]


def read_tables(
    spark: SparkSession, path: str, *, with_source: bool = False, with_ordinal: bool = False, on_bad: str = "fail", most_bad_files: int = 100
) -> DataFrame:
    """All CSV files of a folder stacked by column name, whatever the columns of each file; every column is text.

    A catalogue of first lines (an action) finds the distinct headers, which reach the driver; files don't. Then one scan
    reads all files by position, and each row's names come from the header of its file. Blank names are dropped. A file
    that cannot be opened is an error (`fail`), or it is logged and left out (`skip`); if none can be read, or more than
    `most_bad_files` cannot, that is an error either way.
    """
    if on_bad not in ("fail", "skip"):
        raise ValueError(f"unknown choice {on_bad!r}")
    catalogue = materialised(file_headers(spark, path))[0]
    bad = {r["file"]: r["reason"] for r in catalogue.where("reason is not null").orderBy("file").limit(most_bad_files + 1).collect()}
    if bad and (on_bad == "fail" or len(bad) > most_bad_files):
        raise OSError("; ".join(f"{f}: {r}" for f, r in bad.items()))
    for file, reason in bad.items():
        log.warning("%s skipped: %s", file, reason)
    headers = sorted(r["header"] for r in catalogue.where("header <> ''").select("header").distinct().collect())
    if not headers:
        raise FileNotFoundError(f"no readable file in {path}")
    layouts = [_columns(h) for h in headers]
    fields = T.StructType([T.StructField(f"__c{i}", T.StringType()) for i in range(max(map(len, layouts)))])
    extra = _provenance(with_source, with_ordinal)
    rows = spark.read.schema(fields).csv(path, header=True, quote='"', escape='"')
    # before rows are numbered, so that the scan leaves these files out unopened
    rows = rows.where(~F.col("_metadata.file_path").isin(list(bad))) if bad else rows
    rows = rows.select("*", *extra, F.col("_metadata.file_path").alias("__of"))
    if len(layouts) > 1:
        number = F.array_position(F.array(*[F.lit(h) for h in headers]), F.col("header")) - 1
        rows = rows.join(catalogue.select(F.col("file").alias("__of"), number.alias("__layout")), "__of")
    names = list(dict.fromkeys(n for layout in layouts for n in layout if n.strip()))

    def named(name: str) -> Column:
        having = [(k, layout.index(name)) for k, layout in enumerate(layouts) if name in layout]
        if len(layouts) == 1:
            return F.col(f"__c{having[0][1]}")
        return reduce(lambda c, x: c.when(F.col("__layout") == x[0], F.col(f"__c{x[1]}")), having, F)

    added = [c for c in rows.columns if c not in ("__of", "__layout", *fields.names)]
    return rows.select(*[named(n).alias(n) for n in names], *added)


def load_folder(spark: SparkSession, path: str, schema: str | T.StructType, *, most_bad_files: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of the CSV files of a folder that share a schema, bad files and bad rows left out but listed.

    report: source_file, rows, bad_rows, reason. A file with another header, or one that cannot be read, also one that
    breaks off in the middle, is skipped with its reason and counts no rows; if no file loads, that is an error, and so
    are more than `most_bad_files` that break off. Rows that do not fit the schema are skipped and counted. Good files
    are scanned once (again from the start after one that breaks off) into a table in the checkpoint folder, from which
    rows and counts are read. Rows carry `source_file`.
    """
    fields = _fields(schema)
    catalogue = materialised(file_headers(spark, path))[0]
    wanted = F.lit(",".join(f.name.lower() for f in fields))
    given = F.lower(F.replace(F.replace(F.col("header"), F.lit('"'), F.lit("")), F.lit(", "), F.lit(",")))
    reason = F.coalesce("reason", F.when(given != wanted, F.concat(F.lit("header: "), F.col("header"))))
    judged = catalogue.select("file", reason.alias("reason"))
    broken: dict[str, str] = {}
    while True:
        late = spark.createDataFrame(list(broken.items()), "file string, late string")
        files = judged.join(late, "file", "left").select("file", F.coalesce("reason", "late").alias("reason"))
        bad = {r["file"]: r["reason"] for r in files.where("reason is not null").orderBy("file").limit(most_bad_files + 1).collect()}
        if files.where("reason is null").isEmpty():
            raise OSError(f"no file of {path} could be loaded: {'; '.join(f'{f}: {r}' for f, r in bad.items())}")
        df, good = _scan_text(spark, path, fields)
        typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields]
        rows = df.select(*typed, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_name").alias("source_file"), good.alias("__good"))
        # by their paths files are left out before they are opened; beyond the limit, by a join
        rows = rows.where(~F.col("__file").isin(list(bad))) if bad else rows
        if len(bad) > most_bad_files:
            rows = rows.join(files.where("reason is not null").select(F.col("file").alias("__file")), "__file", "left_anti")
        try:
            stored, _ = materialised(rows)
            break
        except (Py4JJavaError, PySparkException) as e:
            at = _unread(e)
            named = at and files.where((F.regexp_replace("file", "^file:/+", "file:/") == at) & F.col("reason").isNull()).first()
            if not named or len(broken) >= most_bad_files:
                raise
            broken[named["file"]] = "breaks off: FAILED_READ_FILE"
    counts = stored.groupBy("__file").agg(F.count("*").alias("rows"), F.count_if(~F.col("__good")).alias("bad_rows"))
    name = plain_path(F.element_at(F.split("file", "/"), -1))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    report = files.join(counts.withColumnRenamed("__file", "file"), "file", "left")
    report = report.select(name.alias("source_file"), zero("rows"), zero("bad_rows"), "reason").orderBy("source_file")
    return stored.where("__good").select(*_names(fields), plain_path(F.col("source_file")).alias("source_file")), report


def _unread(error: Exception) -> str | None:
    """The file a failed scan names."""
    error = getattr(error, "java_exception", error)
    condition, parameters = (getattr(error, n, lambda: None)() for n in ("getCondition", "getMessageParameters"))
    if not (condition or "").startswith("FAILED_READ_FILE"):
        return None
    return re.sub("^file:/+", "file:/", parameters["path"])


def corrupt_rows(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Number of rows per file, and of those that do not fit the schema."""
    df, good = _scan_text(spark, path, schema)
    marked = df.select(good.alias("good"), F.col("_metadata.file_name").alias("source_file"))
    return marked.groupBy("source_file").agg(F.count("*").alias("rows"), F.count_if(~F.col("good")).alias("bad_rows"))


def with_name_part(df: DataFrame, pattern: str, out: str, *, source: str = "source_file") -> DataFrame:
    """Column taken from the source file name by the first group of a pattern."""
    return df.withColumn(out, F.trim(F.regexp_extract(plain_path(F.col(source)), pattern, 1)))


def plain_path(c: Column) -> Column:
    """Path as text: file metadata escapes blanks and the like, but leaves `+` as it is."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _fields(schema):
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _names(fields):
    return [F.col(f"`{f.name}`") for f in fields]


def _scan_text(spark, path, schema):
    """All columns as text, and the condition a good row meets.

    The condition names every typed column, so a row is good or bad whatever columns a query goes on to use; the
    parser's own corrupt-record mark would depend on column pruning.
    """
    fields = _fields(schema)
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields], T.StructField(_CORRUPT, T.StringType())])
    reader = spark.read.schema(text).options(columnNameOfCorruptRecord=_CORRUPT)
    df = reader.csv(path, header=True, enforceSchema=False, mode="PERMISSIVE", quote='"', escape='"')
    good = F.col(_CORRUPT).isNull()
    for f in fields:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            good = good & (c.isNull() | c.try_cast(f.dataType).isNotNull())
    return df, good


def _provenance(with_source: bool, with_ordinal: bool) -> list[Column]:
    extra = [F.col("_metadata.file_name").alias("source_file")] if with_source else []
    if with_ordinal:
        extra += [
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__line"),
        ]
    return extra
