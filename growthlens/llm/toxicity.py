"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens get the log-odds of toxic against clean labelled texts, under a Dirichlet prior from both; those that stand out
score, all others cost a constant, so that a text scores below zero on average. One linear scan lists every maximal
passage of a text. The chance of a passage's score in a clean text of that length follows the extreme-value law fitted on
clean texts; the evidence of all significant passages is turned into a probability by a logistic curve.
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
from growthlens.llm.shared import kept, logistic

#: A passage is significant if a clean text of its length has one as high with at most this probability.
SIGNIFICANT = 0.05


def segments(place: np.ndarray, gain: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, score) of a sequence in which place[i] scores gain[i] and all else -cost.

    A linear scan: open segments lie on a stack with the totals before and behind them; a new one is merged into the
    nearest that begins lower and ends lower.
    """
    stack: list[list] = []  # first, last, total before, total behind, and the stack's index of the next with a lower begin
    total, previous = 0.0, -1
    for at, score in zip(place.tolist(), gain.tolist()):
        total -= cost * (at - previous - 1)
        previous = at
        segment = [at, at, total, total + score, -1]
        total += score
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= segment[2]:
                j = stack[j][4]
            segment[4] = j
            if j < 0 or stack[j][3] >= segment[3]:
                stack.append(segment)
                break
            segment = [stack[j][0], segment[1], stack[j][2], segment[3], -1]
            del stack[j:]
    return [(a, b, behind - before) for a, b, before, behind, _ in stack]


@dataclass
class Model:
    keys: np.ndarray
    gains: np.ndarray
    cost: float
    rate: float
    scale: float
    curve: np.ndarray

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Per text: evidence of its best passage and of all significant ones, their number, all in natural logarithms of
        one over the chance; and the significant passages (first byte, last byte, -log10 of the chance)."""
        data, offsets = tokens.text_bytes(column)
        begin, end = tokens.spans(tokens.LOWER[data], offsets, tokens.LETTER)
        index = tokens.HashIndex(self.keys).find(tokens.span_hashes(tokens.LOWER[data], begin, end))
        hits = np.flatnonzero(index >= 0)
        first = tokens.counts_per_text(begin, offsets)
        edge = np.searchsorted(hits, first)
        out = np.zeros((len(column), 3))
        passages: list[list] = [[] for _ in range(len(column))]
        for i in np.flatnonzero(np.diff(edge)):
            own = hits[edge[i] : edge[i + 1]]
            n = first[i + 1] - first[i]
            found = segments(own - first[i], self.gains[index[own]], self.cost)
            for a, b, score in found:
                expected = self.scale * n * np.exp(-self.rate * score)
                chance = -np.expm1(-expected)
                proof = -np.log(max(chance, 1e-300))
                out[i, 0] = max(out[i, 0], proof)
                if chance <= SIGNIFICANT:
                    out[i, 1] += proof
                    out[i, 2] += 1
                    at = offsets[i]
                    passages[i].append((int(begin[first[i] + a] - at), int(end[first[i] + b] - at), proof / np.log(10)))
        return out, passages

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.log1p(evidence), np.ones(len(evidence))])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic, clean): how many texts of each label hold the token, per block."""
    for batch in batches:
        for part in tokens.blocks(batch):
            data, offsets = tokens.text_bytes(part.column("text"))
            data = tokens.LOWER[data]
            begin, end = tokens.spans(data, offsets, tokens.LETTER)
            row = np.searchsorted(offsets, begin, side="right") - 1
            # once per text, so that a text that repeats a word counts once
            word, place = np.unique(tokens.span_hashes(data, begin, end), return_inverse=True)
            pair = np.unique(place * part.num_rows + row)
            label = part.column("label").to_numpy()[pair % part.num_rows]
            toxic = np.bincount(pair // part.num_rows, weights=(label == 1).astype(float), minlength=len(word)).astype(np.int64)
            both = np.bincount(pair // part.num_rows, minlength=len(word))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(toxic), pa.array(both - toxic)], ["token", "toxic", "clean"])


def train(
    sample: DataFrame, *, prior: float = 0.0125, least_z: float = 2.8, least_texts: int = 4, most_tokens: int = 20_000, cost_share: float = 0.02
) -> Model:
    """A model from labelled rows (text, label); texts that repeat count once.

    The prior holds `prior` times as many texts as were counted. Three quarters of the texts, by a hash, give the token counts, the rest the extreme-value law and the curve. The
    model is made up of tokens in at least `least_texts` toxic texts with log-odds at least `least_z` deviations above
    zero, at most `most_tokens` of them, the highest first. Where either part has labels of one kind only, every text
    gets one and the same score.
    """
    labelled = sample.groupBy("text").agg(F.max("label").cast("int").alias("label"))
    labelled = kept(labelled.withColumn("counted", F.pmod(F.xxhash64("text"), F.lit(4)) > 0))
    totals = {(r["counted"], r["label"]): float(r["count"]) for r in labelled.groupBy("counted", "label").count().collect()}
    if len(totals) < 4:
        share = sum(n for (_, label), n in totals.items() if label) / max(sum(totals.values()), 1)
        level = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, 1.0, np.array([0.0, 0.0, 0.0, level]))
    toxic, clean = totals[True, 1], totals[True, 0]
    counts = labelled.where("counted").mapInArrow(_counts, "token long, toxic long, clean long")
    counts = counts.groupBy("token").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    weight = (F.col("t") + F.col("c")) * prior  # of a token in the prior: its share over both labels
    odds = lambda k, n: F.log((F.col(k) + weight) / (n + prior * (toxic + clean) - F.col(k)))
    delta = odds("t", toxic) - odds("c", clean)
    z = delta / F.sqrt(1 / (F.col("t") + weight) + 1 / (F.col("c") + weight))
    best = counts.select("token", "t", delta.alias("delta"), z.alias("z")).where((F.col("t") >= least_texts) & (F.col("z") >= least_z))
    table = best.orderBy(F.desc("z"), "token").limit(most_tokens).toArrow()
    gains = np.array(table.column("delta").to_numpy())
    model = Model(table.column("token").to_numpy().view(np.uint64), gains, 1.0, 1.0, 1.0, np.zeros(4))
    if len(gains):
        model.cost = cost_share * float(np.median(gains))
    sample = labelled.where("not counted")
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, words, best): the highest passage of each text."""
        model = shared.value
        index = tokens.HashIndex(model.keys)
        for batch in batches:
            for part in tokens.blocks(batch):
                data, offsets = tokens.text_bytes(part.column("text"))
                begin, end = tokens.spans(tokens.LOWER[data], offsets, tokens.LETTER)
                found = index.find(tokens.span_hashes(tokens.LOWER[data], begin, end))
                first = tokens.counts_per_text(begin, offsets)
                best = np.zeros(part.num_rows)
                for i in range(part.num_rows):
                    own = np.flatnonzero(found[first[i] : first[i + 1]] >= 0)
                    if len(own):
                        best[i] = max(s for *_, s in segments(own, model.gains[found[first[i] + own]], model.cost))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.diff(first)), pa.array(best)], ["label", "words", "best"])

    seen = sample.mapInArrow(measure, "label int, words long, best double").toArrow()
    label, size, best = (np.array(seen.column(k).to_numpy()) for k in ("label", "words", "best"))
    calm = (label == 0) & (size > 0)
    # the law of the best passage in clean texts: chance of score s in n words is 1 - exp(-scale n exp(-rate s))
    spread = best[calm].std() if calm.any() else 0.0
    model.rate = np.pi / (np.sqrt(6) * max(spread, 0.1))
    weights = size[calm] * np.exp(-model.rate * best[calm])
    model.scale = float(1 / max(weights.mean(), 1e-9)) if calm.any() else 1.0
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.blocks(batch):
                found, _ = shared.value.evidence(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("label"), *(pa.array(found[:, k]) for k in range(3))], ["label", "a", "b", "c"])

    proof = sample.mapInArrow(weigh, "label int, a double, b double, c double").toArrow()
    x = np.column_stack([proof.column(k).to_numpy() for k in "abc"])
    model.curve = logistic(np.log1p(x), np.array(proof.column("label").to_numpy()).astype(float))
    return model


PASSAGES = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("proof", T.DoubleType())]))


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double and passages, the significant ones: bytes of the UTF-8 text, and -log10 of their chance.

    Null, empty and wordless texts have no passage and get the score of a text without evidence. Columns of these names
    are replaced; all others are kept.
    """
    base = docs.drop("score", "passages")
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64()), ("proof", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.blocks(batch):
                found, passages = shared.value.evidence(part.column("text"))
                listed = pa.array([[dict(zip(("begin", "stop", "proof"), p)) for p in row] for row in passages], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(found)), listed], schema.names)

    return base.mapInArrow(run, schema)
