"""Session settings shared by the bench, the tests and the command line."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Tables that the innermost `shared_tables` block drops.
_OPEN: ContextVar[list[str] | None] = ContextVar("open_tables", default=None)


def local_session(cores: int | str = "*", *, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("growthlens")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names; a local session that names none gets a scratch folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir():
        return
    if not named and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="growthlens-checkpoint-"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for tables that outlive a job but not the run."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def materialised(df: DataFrame, facts: Mapping[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """The frame computed once and stored in the folder all executors share, for plans with several readers, and
    aggregates over it that are taken while it is written.

    Within a `shared_tables` block the table goes when the block ends, else it stays with the run.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4()}"
    opened = _OPEN.get()
    if opened is not None:
        opened.append(path)
    seen = Observation()
    counted = df.observe(seen, *[c.alias(n) for n, c in facts.items()]) if facts else df
    counted.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if facts else {}


@contextmanager
def shared_tables(spark: SparkSession) -> Iterator[None]:
    """Tables materialised in this block are dropped when it ends, so results must be written or collected within it."""
    token = _OPEN.set([])
    try:
        yield
    finally:
        paths = _OPEN.get() or []
        _OPEN.reset(token)
        for name in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
