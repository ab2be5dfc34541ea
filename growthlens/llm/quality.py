"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. A line is described by its own shape and by that of the lines before and behind it, in binned
features; transitions are learned. Lines of labelled documents take the document's label. A document's share of bad text
is the sum of its lines' forward-backward marginals weighted by line length; a logistic curve turns it into the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.llm import tokens
from growthlens.llm.crf import Adam, marginals, observed_pairs
from growthlens.llm.shared import kept, logistic

BINS = 8
#: Classes of bytes whose share of a line is a feature.
CLASSES = {
    "upper": lambda b: (b >= 65) & (b <= 90),
    "lower": lambda b: (b >= 97) & (b <= 122),
    "digit": lambda b: (b >= 48) & (b <= 57),
    "blank": lambda b: (b == 32) | (b == 9),
    "stop": lambda b: np.isin(b, list(b".,;?")),
    "bang": lambda b: b == 33,
    "bar": lambda b: b == 124,
    "symbol": lambda b: np.isin(b, list(b"#$%&*<=>@[]\\^_`{}~+/")),
    "beyond": lambda b: b >= 128,
}


def describe(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes plus one, and the number of lines of each text (at least one)."""
    data, offsets = tokens.text_bytes(column)
    cuts = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((offsets[:-1], cuts + 1)), kind="stable")
    # a line break at the very end of a text opens an empty last line, which begins where the next text does
    row = np.repeat(np.arange(len(column)), 1 + np.diff(np.searchsorted(cuts, offsets)))
    stop = np.minimum(np.append(begin[1:], len(data)), offsets[1:][row])
    stop -= (stop > begin) & (data[np.maximum(stop - 1, 0)] == 10) if len(data) else 0
    size = stop - begin
    columns = [np.log1p(size)]
    for of in CLASSES.values():
        total = np.concatenate(([0], np.cumsum(of(np.arange(256, dtype=np.int64))[data])))
        columns.append((total[stop] - total[begin]) / np.maximum(size, 1))
    word_begin, word_end = tokens.spans(data, offsets, tokens.NOT_SPACE)
    hashes = tokens.span_hashes(tokens.LOWER[data], word_begin, word_end)
    line = np.searchsorted(begin, word_begin, side="right") - 1
    words = np.bincount(line, minlength=len(begin))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    columns.append(np.bincount(line, weights=again, minlength=len(begin)) / np.maximum(words, 1))
    columns.append(np.bincount(line, weights=word_end - word_begin, minlength=len(begin)) / np.maximum(words, 1))
    shape = np.zeros(len(begin), np.uint64)
    np.add.at(shape, line, tokens.mix(hashes))
    key = tokens.mix(shape + tokens.mix(row.astype(np.uint64)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    columns.append((count[inverse] > 1).astype(float) * (words > 0))
    return np.column_stack(columns), size + 1, np.bincount(row, minlength=len(column))


@dataclass
class Model:
    edges: np.ndarray  # per feature, the bounds between bins
    weights: np.ndarray  # (own, before, behind) x feature x bin x label
    transition: np.ndarray
    start: np.ndarray
    curve: np.ndarray

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def cells(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Positions in the flat table of weights: own bins, then those of the neighbours; the last bin means no line."""
        own = self.bins(features)
        n, k = own.shape
        before, behind = np.full_like(own, BINS), np.full_like(own, BINS)
        first = np.zeros(n, dtype=bool)
        first[np.cumsum(lines) - lines] = True
        inner = np.flatnonzero(~first)
        before[inner], behind[inner - 1] = own[inner - 1], own[inner]
        place = np.arange(k) * (BINS + 1)
        return np.concatenate([own + place, before + place + k * (BINS + 1), behind + place + 2 * k * (BINS + 1)], axis=1)

    def lines(self, features: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return marginals(self.weights[self.cells(features, lines)].sum(axis=1), lines, self.transition, self.start)

    def bad_share(self, features: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted marginal of bad lines per text, and of its worst line."""
        found, _ = self.lines(features, lines)
        first = np.cumsum(lines) - lines
        bad = found[:, 0]
        return np.column_stack([np.add.reduceat(bad * size, first) / np.add.reduceat(size, first), np.maximum.reduceat(bad, first)])

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        shares = self.bad_share(*describe(column))
        x = np.column_stack([shares, np.ones(len(shares))])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, *, rounds: int = 60) -> Model:
    """A model from whole texts and their labels (1 good); without both labels every text gets one score."""
    labels = np.asarray(labels, dtype=np.int64)
    column = pa.array(texts, pa.large_string())
    features, size, lines = describe(column) if texts else (np.zeros((0, len(CLASSES) + 4)), np.zeros(0), np.zeros(0, np.int64))
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1]))[: BINS - 1] if len(f) else np.zeros(0) for f in features.T]
    model = Model(edges, np.zeros((3 * features.shape[1] * (BINS + 1), 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    if not len(labels) or labels.min() == labels.max():
        model.curve = logistic(np.zeros((len(labels), 2)), labels.astype(float))
        return model
    cells, label = model.cells(features, lines), np.repeat(labels, lines)
    want, first = observed_pairs(label, lines, 2), np.cumsum(lines) - lines
    # documents of the rarer label weigh as much as the others
    weight = np.where(label == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    adam = Adam(model.weights, model.transition, model.start, rate=0.1)
    for _ in range(rounds):
        found, pairs = model.lines(features, lines)
        rest = (np.eye(2)[label] - found) * weight[:, None]
        gradient = np.stack([np.bincount(cells.ravel(), weights=np.repeat(rest[:, k], cells.shape[1]), minlength=len(model.weights)) for k in (0, 1)], axis=1)
        adam.step(gradient / len(label) - 1e-4 * model.weights, (want - pairs) / len(label) - 1e-3 * model.transition, rest[first].sum(axis=0) / len(first))
    model.curve = logistic(model.bad_share(features, size, lines), labels.astype(float))
    return model


def train(sample: DataFrame) -> Model:
    """A model from labelled rows (text, label); the sample, whose size its maker bounds, is gathered on the driver."""
    rows = kept(sample.select("text", "label")).toArrow().sort_by([("text", "ascending"), ("label", "ascending")])
    return fit(rows.column("text").to_pylist(), np.array(rows.column("label").to_numpy()))


LINES = T.ArrayType(T.DoubleType())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double, the probability that the text is good. Null and empty texts count as one empty line.

    A column of that name is replaced; all others are kept.
    """
    base = docs.drop("score")
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.blocks(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column("text")))], schema.names)

    return base.mapInArrow(run, schema)


def label_lines(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, bad array<double>): the marginal of `bad` for every line of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.blocks(batch):
                features, _, lines = describe(part.column("text"))
                found, _ = shared.value.lines(features, lines)
                offsets = pa.array(np.concatenate(([0], np.cumsum(lines))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(found[:, 0]))], ["doc_id", "bad"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("bad", LINES)]))
