"""Exact top-k by inner product over integer vectors, by columnar branch and bound.

Candidates lie in blocks of fixed size, one array per dimension. For a block of queries, scores grow block of dimensions
by block; what the remaining dimensions can still add is bounded by the norms of what remains (Cauchy-Schwarz), and
candidates that can't reach a query's k-th best score so far are dropped, the rest compacted. Spark deals candidate
blocks and query blocks out in shards of fixed size; the best of each shard are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates in a block, queries in a block, blocks of candidates in a shard, dimensions added before each bound.
CANDIDATES, QUERIES, BLOCKS, DIMENSIONS = 4096, 256, 16, 16
#: Components up to this size keep products exact in double precision for any usual number of dimensions.
_EXACT = 1 << 53


def quantized(vectors: DataFrame, id_column: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, values array<long>): floor(scale * x) of every component; vectors that are null, empty, or hold a null or
    non-finite component are left out, and so are rows without an id."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    values = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return vectors.where(F.col(id_column).isNotNull() & (F.size(vector) > 0) & finite).select(F.col(id_column).cast("long").alias("id"), values.alias("values"))


def _packed(rows: DataFrame, size: int, number: str, blob: str) -> DataFrame:
    """Rows packed into blocks of up to `size` vectors of one length within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.diff(batch.column("values").offsets.to_numpy())
            for w in np.unique(width):
                own = batch.filter(pa.array(width == w))
                for i in range(0, own.num_rows, size):
                    part = own.slice(i, size)
                    ids = part.column("id").to_numpy()
                    values = part.column("values").flatten().to_numpy().reshape(len(ids), w)
                    order = np.argsort(ids, kind="stable")
                    flat = np.ascontiguousarray(values[order].T)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(w)], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([flat.tobytes()])], ["width", number, blob]
                    )

    return rows.mapInArrow(run, f"width int, {number} binary, {blob} binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(query_ids, queries, ids, columns, k, found) -> None:
    """Update found[i] = (ids, scores), the best of query i, with a block of candidates in vertical layout.

    queries: dimension x query, columns: dimension x candidate; both integer.
    """
    width = len(columns)
    norm = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(width, 1)
    if norm >= 2.0**62:
        queries, columns, exact = queries.astype(object), columns.astype(object), False
    else:
        exact = norm < _EXACT
    number = np.float64 if exact else queries.dtype
    q, c = queries.astype(number), columns.astype(number)
    cuts = list(range(0, width, DIMENSIONS)) + [width]
    # norms of what remains behind each cut; a little above the true value, so that rounding never drops a candidate
    mass = lambda m: np.sqrt(np.cumsum((m.astype(float) ** 2)[::-1], axis=0)[::-1]) * (1 + 1e-9)
    q_mass, c_mass = mass(q), mass(c)
    scores = q[: cuts[1]].T @ c[: cuts[1]]
    for i in range(q.shape[1]):
        own_ids, own_scores = found[i]
        alive, total = np.flatnonzero(ids != query_ids[i]), None
        total = scores[i][alive]
        floor = min(own_scores) if len(own_scores) >= k else None
        for a, b in zip(cuts[1:-1], cuts[2:]):
            if floor is not None:
                bound = total.astype(float) + q_mass[a, i] * c_mass[a][alive]
                stay = bound * (1 + np.sign(bound) * 1e-9) + 1e-6 >= float(floor)
                if not stay.all():
                    alive, total = alive[stay], total[stay]
            if not len(alive):
                break
            total = total + q[a:b, i] @ c[a:b, alive]
        merged = np.concatenate((own_scores, np.array(total.tolist(), dtype=object if not exact and number == object else np.int64)))
        found[i] = _best(np.concatenate((own_ids, ids[alive])), merged, k)


def top_k(vectors: DataFrame, queries: Column, *, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): for every row with `queries` true, its k best other rows by inner product.

    Ties go to the smaller id. Vectors of different lengths don't meet. Of rows that repeat an id, those with one score
    count once; none meets a query of its own id. Fewer candidates than k give fewer rows.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_column, vector, scale)
    asked = quantized(vectors.where(queries), id_column, vector, scale)
    count = rows.count()
    shards = max(1, -(-count // (CANDIDATES * BLOCKS)))
    dealt = rows.repartition(max(shards, spark.sparkContext.defaultParallelism), "id")
    blocks = _packed(dealt, CANDIDATES, "ids", "columns").withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)))
    groups = _packed(asked.repartition(F.pmod(F.xxhash64("id"), F.lit(max(1, count // (50 * QUERIES))))), QUERIES, "query_ids", "queries")
    copies = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    met = blocks.join(copies, ["shard", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple] = {}
        for batch in batches:
            for width, ids, columns, query_ids, asked in zip(*(batch.column(n).to_pylist() for n in ("width", "ids", "columns", "query_ids", "queries"))):
                numbers = np.frombuffer(query_ids, np.int64)
                if query_ids not in best:
                    if len(best) >= 64:  # bounded memory: what is known so far goes out, and the search begins anew
                        yield from _listed(best)
                        best = {}
                    best[query_ids] = (numbers, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(numbers))
                candidates = np.frombuffer(ids, np.int64)
                search_block(
                    numbers, np.frombuffer(asked, np.int64).reshape(width, -1), candidates,
                    np.frombuffer(columns, np.int64).reshape(width, -1), k, best[query_ids][1],
                )
        yield from _listed(best)

    def _listed(best) -> Iterator[pa.RecordBatch]:
        for numbers, found in best.values():
            size = [len(i) for i, _ in found]
            if sum(size):
                ids = np.concatenate([i for i, _ in found])
                scores = np.concatenate([s for _, s in found]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, size)), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

    found = met.select("width", "ids", "columns", "query_ids", "queries").mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
