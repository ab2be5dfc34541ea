"""Regression trees for every series of a panel at once.

Rows are shuffled by series, and a task takes as many whole series as fit a block. Trees grow level by level for all
series of the block together: histograms of weight and target are kept by (series and node, bin) of each feature, the
best split of every node is read off their running sums, and rows move on to the next level. The jobs Spark runs, and
the steps within a task, don't depend on the number of series. A series is as long as its calendar, so it fits a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators.common import key_struct, q, qs

#: Rows worked on at a time, whole series each.
BLOCK_ROWS = 1 << 16
#: Bins of a feature within a series.
BINS = 64
#: A split has to be better by this share to count as better, so rounding decides nothing.
_BETTER = 1e-9


def binned(x: np.ndarray, train: np.ndarray, series: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Bin of every value: the number of its series' edges below it. Edges lie halfway between neighbouring training
    values, all of them if they are few, else evenly spread by rank. Rows are in runs of one series."""
    out = np.zeros(len(x), np.int64)
    starts = np.flatnonzero(np.diff(series, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(x)]):
        known = np.unique(x[a:b][train[a:b]])
        edges = (known[1:] + known[:-1]) / 2
        if len(edges) >= bins:
            edges = edges[np.arange(bins - 1) * len(edges) // (bins - 1)]
        out[a:b] = np.searchsorted(edges, x[a:b], side="left")
    return out


def grown(bins: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    """Value of every row's leaf in one tree per series. bins: feature x row; rows of weight 0 are only moved along;
    node: number of the row's series, from 0 on without gaps, each with some weight."""
    rows, out = np.arange(len(y)), np.zeros(len(y))
    width = int(bins.max(initial=0)) + 1
    for level in range(depth + 1):
        count = int(node.max(initial=-1)) + 1
        if not count:
            break
        weight, total = np.bincount(node, w, count), np.bincount(node, w * y, count)
        out[rows] = (total / weight)[node]
        if level == depth:
            break
        gain, feature, cut = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
        least = _BETTER * np.bincount(node, w * y * y, count)
        for f in range(len(bins)):
            key = node * width + bins[f][rows]
            left_w = np.cumsum(np.bincount(key, w, count * width).reshape(count, width), axis=1)[:, :-1]
            left = np.cumsum(np.bincount(key, w * y, count * width).reshape(count, width), axis=1)[:, :-1]
            if not left.size:
                continue
            right_w, right = weight[:, None] - left_w, total[:, None] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                score = left**2 / left_w + right**2 / right_w - (total**2 / weight)[:, None]
            score = np.where((left_w > 0.5) & (right_w > 0.5), score, -np.inf)
            # of cuts that are equal but for rounding the first one counts
            at = (score >= score.max(axis=1, keepdims=True) - least[:, None]).argmax(axis=1)
            best = score[np.arange(count), at]
            better = best > gain + least
            gain, feature, cut = np.where(better, best, gain), np.where(better, f, feature), np.where(better, at, cut)
        moves = feature[node] >= 0
        rows, node, y, w = rows[moves], node[moves], y[moves], w[moves]
        right = bins[feature[node], rows] > cut[node]
        _, node = np.unique(node * 2 + right, return_inverse=True)
    return out


def _draws(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a row is drawn for a tree: a Poisson number of mean 1 that depends on the row, tree and seed alone."""
    x = row.view(np.uint64) ^ np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    below = np.exp(-1.0) * np.cumsum(1 / np.cumprod([1, *range(1, 12)]))
    return np.searchsorted(below, (x >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def predicted(
    x: np.ndarray, y: np.ndarray, train: np.ndarray, series: np.ndarray, row: np.ndarray, *, kind: str, trees: int,
    depth: int, rate: float, seed: int,
) -> np.ndarray:
    """Predictions for all rows of a block. x: feature x row; y: 0 where `train` is false; row: a hash of each row.

    `rf` averages trees grown on drawn rows (a tree that draws none of a series uses all of them); `gbt` adds trees
    grown on what is left, each shrunk by `rate`. A series without training rows gets NaN.
    """
    bins = np.stack([binned(f, train, series) for f in x]) if len(x) else np.zeros((1, len(y)), np.int64)
    some = np.bincount(series, train)[series] > 0
    out = np.full(len(y), np.nan)
    bins, y, w, row = bins[:, some], y[some], train[some].astype(float), row[some]
    _, node = np.unique(series[some], return_inverse=True)
    if not len(y):
        return out
    total = np.zeros(len(y))
    if kind == "rf":
        for tree in range(trees):
            drawn = w * _draws(row, tree, seed)
            none = np.bincount(node, drawn)[node] == 0
            total += grown(bins, y, np.where(none, w, drawn), node, depth) / trees
    else:
        total += (np.bincount(node, w * y) / np.bincount(node, w))[node]
        for _ in range(trees):
            total += rate * grown(bins, np.where(w > 0, y - total, 0.0), w, node, depth)
    out[some] = total
    return out


def fit_series_trees(
    rows: DataFrame, *, keys: Sequence[str], time: str, target: str, features: Sequence[str], train, kind: str, trees: int, depth: int,
    rate: float, seed: int,
) -> DataFrame:
    """keys, time, target and `predicted` of the rows for which `train` is false, one model per series.

    Numbers must be doubles, features without missing values. Rows where `train` is null count as false.
    """
    marked = rows.select(
        *qs([*keys, time, target]), *qs(features), F.coalesce(train, F.lit(False)).alias("__train"), F.xxhash64(key_struct(keys)).alias("__s"),
        F.xxhash64(key_struct([*keys, time])).alias("__row"),
    )
    ordered = marked.repartition(*qs(keys)).sortWithinPartitions("__s", *qs(keys), q(time)) if keys else marked.coalesce(1).sortWithinPartitions(q(time))
    schema = marked.select(*qs([*keys, time, target])).schema.add("predicted", "double")

    def block(part: pa.Table) -> pa.RecordBatch:
        numbers = [part.column(f).to_numpy() for f in features]
        train = part.column("__train").to_numpy()
        # series with one hash by chance differ in their keys
        names = [part.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
        change = np.zeros(len(train), bool)
        for name in [part.column("__s").to_numpy(), *names]:
            change[1:] |= name[1:] != name[:-1]
        y = np.where(train, part.column(target).to_numpy(zero_copy_only=False), 0.0)
        found = predicted(
            np.array(numbers).reshape(len(features), len(y)), y, train, np.cumsum(change), part.column("__row").to_numpy(), kind=kind,
            trees=trees, depth=depth, rate=rate, seed=seed,
        )
        asked = part.select([*keys, time, target]).filter(pa.array(~train)).combine_chunks()
        columns = [*(asked.column(i).combine_chunks() for i in range(asked.num_columns)), pa.array(found[~train], from_pandas=True)]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            hashes = batch.column("__s").to_numpy()
            edges = np.flatnonzero(np.diff(hashes)) + 1
            cut = int(edges[-1]) if len(edges) else 0
            if held and hashes[0] != held[-1].column("__s")[-1].as_py() and size >= BLOCK_ROWS:
                yield block(pa.Table.from_batches(held))
                held, size = [], 0
            if cut and size + cut >= BLOCK_ROWS:  # the last series may go on in the next batch
                yield block(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if size:
            yield block(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, schema)
