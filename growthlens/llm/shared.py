"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.session import checkpoint_dir

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Whether the shuffle files of a query go as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """The frame, computed once and written as a table into the folder that all executors share.

    Tables lie below the application's id; they outlive lost executors, and `clear_kept` removes them. Nothing reads the
    shuffle files behind a finished table again, so they are dropped at once instead of piling up on local disks.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4()}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/growthlens-{spark.sparkContext.applicationId}"


def clear_kept(spark: SparkSession) -> None:
    """Remove what this application has kept, once no frame that reads it is in use."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_any(df: DataFrame, most_rows: int) -> DataFrame:
    """A stored frame, marked for broadcast only if it has at most so many rows; joins shuffle it otherwise."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the frame has them, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id, divisor: int):
    """crc32 of the id's decimal text, modulo the divisor; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % divisor


def most_frequent(counts: DataFrame, most: int):
    """Numpy arrays of the keys (long) with the highest counts and their counts, at most `most` of them.

    The limit is the least power of two that leaves so few, so the number that reaches the driver is bounded.
    """
    import numpy as np

    counts = kept(counts.select("key", "count"))
    classes = counts.groupBy(F.floor(F.log2("count")).alias("power")).count().orderBy(F.desc("power")).collect()
    least, room = None, most
    for power, n in classes:
        if n > room:
            break
        least, room = 2**power, room - n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(F.col("count") >= least).toArrow()
    return rows.column("key").to_numpy(), rows.column("count").to_numpy()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b); nodes without links are not listed.

    Every round takes the smallest label among a node and its neighbours and then follows that label once, so labels
    travel by doubling steps. Joins are shuffled: the links grow with the data.
    """
    ends = links.where("a <> b").select("a", "b")
    back = ends.select(F.col("b").alias("a"), F.col("a").alias("b"))
    selves = ends.select("a").union(back.select("a")).select("a", F.col("a").alias("b"))
    both = kept(ends.union(back).union(selves).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = both.join(of_b.hint("merge"), "b").groupBy(F.col("a").alias("node"))
        now = kept(near.agg(F.min("near").alias("component"), F.max(F.when(F.col("a") == F.col("b"), F.col("near"))).alias("was")))
        if now.where("component <> was").isEmpty():
            return now.select("node", "component")
        follow = now.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = now.join(follow.hint("merge"), "component").select("node", F.col("next").alias("component"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trained, most_rows: int) -> DataFrame:
    """(doc_id, text, label int): about `most_rows` labelled rows that may be learned from, chosen by a hash of the id.

    Only ids and labels of the sample are gathered and broadcast; texts are filtered where they are read. Null texts,
    null labels and ids with contradicting labels are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & trained)
    total = known.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    some = known.where(chance < min(1.0, most_rows / max(total, 1)))
    some = some.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other")).where("label = other").drop("other")
    texts = docs.where("text is not null").select("doc_id", "text")
    return texts.join(small_or_any(kept(some), 4 * most_rows), "doc_id")


#: Weights that travel in one row.
CHUNK = 1024


def averaged(rows: DataFrame, learn):
    """The weights that the tasks have learned from their rows, averaged, as one flat numpy array; None without any.

    learn(record batches) returns a list of arrays, of the same shapes in all tasks, and how much they count. Chunks of
    them are shuffled and summed, so that one set of weights reaches the driver however many tasks there are.
    """
    import numpy as np
    import pyarrow as pa

    names = ["chunk", "amount", "weights"]

    def row(chunk, amount, weights):
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([amount], pa.float64()), pa.array([weights.tobytes()], pa.binary())], names)

    def run(batches):
        arrays, amount = learn(batches)
        if amount > 0:
            flat = np.concatenate([x.ravel() for x in arrays]).astype(np.float64)
            for i in range(0, len(flat), CHUNK):
                yield row(i // CHUNK, amount, flat[i : i + CHUNK])

    def mean(batches):
        now, total, mass = None, None, 0.0
        for batch in batches:
            for chunk, amount, weights in zip(*(batch.column(n).to_pylist() for n in names)):
                if chunk != now:
                    if now is not None:
                        yield row(now, mass, total / mass)
                    now, total, mass = chunk, 0.0, 0.0
                total, mass = total + amount * np.frombuffer(weights), mass + amount
        if now is not None:
            yield row(now, mass, total / mass)

    schema = "chunk int, amount double, weights binary"
    sent = rows.mapInArrow(run, schema).repartition("chunk").sortWithinPartitions(*names)
    found = sent.mapInArrow(mean, schema).toArrow().sort_by("chunk").column("weights").to_pylist()
    return np.concatenate([np.frombuffer(x) for x in found]) if found else None


def logistic(x, y, *, rounds: int = 60, ridge: float = 1e-2):
    """Weights, the intercept last, of a ridge logistic regression by Newton steps; numpy arrays of bounded samples."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
