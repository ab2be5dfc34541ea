"""Language of texts by a linear-chain conditional random field over words.

Words (runs of letters) carry affix, character n-gram and whole-word features, hashed into one table of weights. Each
line is a chain; transitions between languages are learned from lines that are spliced together, so lines that switch
language are labelled word by word. All labelled rows are learned from, in one pass of tasks whose weights are averaged. A document's language has the highest sum of forward-backward marginals over its
words; the score is that sum divided by the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.llm import tokens
from growthlens.llm.crf import Adam, marginals, observed_pairs
from growthlens.llm.shared import averaged

UNDETERMINED = "und"
#: Bits of the table of feature weights.
TABLE_BITS = 16
#: Bytes of text worked on at a time; the features of a block take about a hundred times as much memory.
BLOCK = 1 << 19
#: Step size of the pass over all rows at its begin.
FIRST_RATE = 0.02


def word_features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word in one array, and their number per word: n-grams of 1 to 4 bytes of the word between
    two border marks, of which those with a mark are its affixes, and the word itself as the lexicon feature."""
    size = end - begin
    bordered = size + 2
    edge = np.cumsum(bordered) - bordered
    flat = np.full(int(bordered.sum()), 1, dtype=np.uint64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(edge + 1, size) + inner] = data[np.repeat(begin, size) + inner]
    word = np.repeat(np.arange(len(size)), bordered)
    left = np.repeat(edge + bordered, bordered) - np.arange(len(flat))  # bytes from here to the word's end
    ids, owner = [tokens.span_hashes(data, begin, end)], [np.arange(len(size), dtype=np.int32)]
    gram = np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, 5):
        gram = gram * np.uint64(257) + np.append(flat[n - 1 :], np.zeros(n - 1, np.uint64))
        fits = left >= n
        ids.append(tokens.mix(gram[fits] + np.uint64(n << 40)))
        owner.append(word[fits].astype(np.int32))
    order = np.argsort(np.concatenate(owner), kind="stable")
    ids = np.concatenate(ids)[order]
    return (ids >> np.uint64(64 - TABLE_BITS)).astype(np.int32), np.bincount(np.concatenate(owner), minlength=len(size))


def _words(column: pa.Array) -> tuple[np.ndarray, ...]:
    """data, distinct words (begin, end), each word's distinct number, the row of each word and its chain lengths."""
    data, offsets = tokens.text_bytes(column)
    data = tokens.LOWER[data]
    begin, end = tokens.spans(data, offsets, tokens.LETTER)
    row = np.searchsorted(offsets, begin, side="right") - 1
    _, first, number = np.unique(tokens.span_hashes(data, begin, end), return_index=True, return_inverse=True)
    line = np.searchsorted(np.flatnonzero(data == 10), begin)
    change = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 0))
    return data, begin[first], end[first], number, row, np.diff(np.append(change, len(begin)))


def _sums(weights: np.ndarray, ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features, label by label, so that only one column is spread out at a time."""
    out = np.zeros((len(edge), weights.shape[1]))
    for k in range(weights.shape[1] if len(edge) else 0):
        out[:, k] = np.add.reduceat(weights[:, k][ids], edge)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def word_scores(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        ids, size = word_features(data, begin, end)
        return _sums(self.weights, ids, np.cumsum(size) - size) / np.sqrt(size)[:, None]

    def label(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and marginals of every word, and the chain lengths."""
        data, begin, end, number, row, lengths = _words(column)
        if not len(row):
            return row, np.zeros((0, len(self.languages))), lengths
        found, _ = marginals(self.word_scores(data, begin, end)[number], lengths, self.transition, self.start)
        return row, found, lengths


class _Lines:
    """Labelled lines made ready for training. A share of the lines is spliced to the line before."""

    def __init__(self, lines: list[tuple[str, int]], labels: int, rng: np.random.Generator, spliced: float):
        chains: list[list[tuple[str, int]]] = []
        for line in (lines[i] for i in rng.permutation(len(lines))):
            if chains and rng.random() < spliced:
                chains[-1].append(line)
            else:
                chains.append([line])
        flat = [part for chain in chains for part in chain]
        data, begin, end, self.number, row, _ = _words(pa.array([x for x, _ in flat], pa.large_string()))
        label = np.array([y for _, y in flat], dtype=np.int64)[row]
        lengths = np.bincount(np.repeat(np.arange(len(chains)), [len(c) for c in chains])[row], minlength=len(chains))
        self.lengths = lengths[lengths > 0]
        self.words = len(row)
        if not self.words:
            return
        self.ids, self.size = word_features(data, begin, end)
        self.edge, self.root = np.cumsum(self.size) - self.size, np.sqrt(self.size)[:, None]
        self.seen = np.bincount(self.number * labels + label, minlength=len(self.size) * labels).reshape(-1, labels).astype(float)
        self.pairs = observed_pairs(label, self.lengths, labels)
        self.firsts = (np.cumsum(self.lengths) - self.lengths).astype(np.int64)
        self.begun = np.bincount(label[self.firsts], minlength=labels)

    def gradients(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        labels = len(model.languages)
        score = _sums(model.weights, self.ids, self.edge) / self.root
        found, pairs = marginals(score[self.number], self.lengths, model.transition, model.start)
        got = np.stack([np.bincount(self.number, weights=found[:, k], minlength=len(self.size)) for k in range(labels)], axis=1)
        rest = (self.seen - got) / self.root
        spread = lambda k: np.bincount(self.ids, weights=np.repeat(rest[:, k], self.size), minlength=1 << TABLE_BITS)
        gradient = np.stack([spread(k) for k in range(labels)], axis=1)
        n, begun = self.words, self.begun - found[self.firsts].sum(axis=0)
        return gradient / n - 1e-6 * model.weights, (self.pairs - pairs) / n, begun / len(self.firsts)


def _labelled_lines(text: str, label: int) -> Iterator[tuple[str, int]]:
    return ((x, label) for x in text.split("\n") if x.strip())


def fit(
    texts: list[str], languages: list[str], *, names: list[str] | None = None, rounds: int = 15, spliced: float = 0.3, seed: int = 7
) -> Model:
    """Weights from whole texts of one language each. A share of the lines is spliced to a line of another text.

    names: the languages to tell apart; those of the texts by default.
    """
    names = sorted(set(languages)) if names is None else names
    label_of = {x: i for i, x in enumerate(names)}
    lines = [line for t, y in zip(texts, languages) for line in _labelled_lines(t, label_of[y])]
    model = Model(names, np.zeros((1 << TABLE_BITS, len(names))), np.zeros((len(names),) * 2), np.zeros(len(names)))
    ready = _Lines(lines, len(names), np.random.default_rng(seed), spliced) if lines else None
    if ready is None or not ready.words:
        return model
    adam = Adam(model.weights, model.transition, model.start, rate=0.15)
    for _ in range(rounds):
        adam.step(*ready.gradients(model))
    return model


def learn_all(rows: DataFrame, start: Model, *, spliced: float = 0.3, seed: int = 7) -> Model:
    """The model after one pass over all rows (text, lang), from the weights of `start`.

    Every task takes a step for each block of lines, and the weights of the tasks are averaged by their numbers of words.
    Rows of other languages than those of the model are passed over.
    """
    shared = rows.sparkSession.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], float]:
        given = shared.value
        model = Model(given.languages, given.weights.copy(), given.transition.copy(), given.start.copy())
        adam, words, rng = Adam(model.weights, model.transition, model.start, rate=FIRST_RATE), 0, np.random.default_rng(seed)
        label_of = {x: i for i, x in enumerate(model.languages)}
        held, size = [], 0

        def step() -> int:
            ready = _Lines(held, len(model.languages), rng, spliced)
            if ready.words:
                adam.rate = FIRST_RATE / np.sqrt(1 + adam.turn)
                adam.step(*ready.gradients(model))
            held.clear()
            return ready.words

        for batch in batches:
            for part in tokens.blocks(batch, "text", BLOCK):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    for line in _labelled_lines(text, label_of[lang]) if lang in label_of else ():
                        held.append(line)
                        size += len(line[0])
                        if size >= BLOCK:
                            words, size = words + step(), 0
        if held:
            words += step()
        tokens.release()
        return [model.weights, model.transition, model.start], float(words)

    found = averaged(rows.select("text", "lang"), learn)
    if found is None:
        return start
    labels = len(start.languages)
    weights, transition, first = np.split(found, [labels << TABLE_BITS, (labels << TABLE_BITS) + labels * labels])
    return Model(start.languages, weights.reshape(-1, labels), transition.reshape(labels, labels), first)


def fit_on(
    docs: DataFrame, trained: Column, *, per_language: int = 120, most_languages: int = 64, most_chars: int = 200_000
) -> Model:
    """A model from all labelled rows of the `most_languages` most frequent languages.

    About `per_language` rows of each, chosen by a hash of the id, each of at most `most_chars` characters, only give the
    weights from which all tasks start; no others reach the driver.
    """
    rows = docs.where(trained & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return Model([], np.zeros((1 << TABLE_BITS, 0)), np.zeros((0, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"]))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    picked = rows.where((chance < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))) & (F.length("text") <= most_chars))
    first = picked.select("doc_id", "text", "lang").limit(2 * per_language * len(counts)).toArrow()
    first = first.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    names = sorted(r["lang"] for r in counts)
    return learn_all(rows, fit(first.column("text").to_pylist(), first.column("lang").to_pylist(), names=names))


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double.

    A null text, or one without a letter, gets `und` and score 0, as does everything if no language was learned. Ties
    go to the language first in the alphabet. Columns of these names are replaced; all others are kept.
    """
    base = docs.drop("lang_pred", "score").withColumn("__lettered", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([f for f in base.schema.fields if f.name != "__lettered"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for part in tokens.blocks(batch, text, BLOCK):
                n, labels = part.num_rows, len(model.languages)
                total = np.zeros((n, max(labels, 1)))
                count = np.zeros(n)
                if labels:
                    row, found, _ = model.label(part.column(text))
                    count = np.bincount(row, minlength=n)
                    total = np.stack([np.bincount(row, weights=found[:, k], minlength=n) for k in range(labels)], axis=1)
                lettered = part.column("__lettered").to_numpy(zero_copy_only=False) & (count > 0)
                best = total.argmax(axis=1)
                score = np.where(lettered, total[np.arange(n), best] / np.maximum(count, 1), 0.0)
                predicted = names[np.where(lettered, best, labels)]
                kept = [c for c, f in zip(part.columns, part.schema) if f.name != "__lettered"]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(predicted, pa.string()), pa.array(np.minimum(score, 1.0))], [f.name for f in schema.fields]
                )
        tokens.release()

    return base.mapInArrow(run, schema)
