"""Language-model scores: a causal self-attention model over subword ids, next to a unigram base over words.

The attention model has one layer. Its weights come from one pass over all training texts: tasks start from the same
weights, which a few texts have given, take steps on all their windows in numpy, and their weights are averaged. It
predicts the class of the next subword; within a class, subwords have their smoothed shares, counted in all these texts. Texts are scored in overlapping windows: each window predicts the
last part of its positions and sees the part before as context, so every subword is scored once. Windows run in batches
under a causal mask.

The base is a unigram model with one added to each count, gathered from all training texts. A word is known by a 64-bit
hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.llm import tokens
from growthlens.llm.bpe import Vocabulary, gather, merge
from growthlens.llm.crf import Adam
from growthlens.llm.shared import averaged, kept, most_frequent

#: Positions a window predicts, and positions of context before them.
STRIDE, CONTEXT = 24, 8
WINDOW = STRIDE + CONTEXT
WIDTH, CLASSES, UNITS = 16, 64, 2048
#: Windows worked on at a time; their weights should fit into a core's cache.
WINDOWS = 256
#: Windows whose gradients are computed together.
GROUP = 64
#: Step size of the pass over all texts at its begin.
FIRST_RATE = 0.004
#: Word counts that every task gets: 16 bytes each; the counts of all other words are joined.
MOST_FREQUENT = 1 << 18
#: Words counted together before the counts are shuffled.
BLOCK_WORDS = 4_000_000
#: The end of a text as a word; no other word has this hash but by chance.
END = np.uint64(0x656E64206F662074)


#: Distinct pre-tokens that a Python worker remembers between batches.
REMEMBERED = 400_000
#: Pre-tokens that are merged together.
MERGED = 50_000


class BatchEncoder:
    """Subword ids of texts: pre-tokens are runs of letters, digits, other marks or white space by their bytes, each with
    a blank in front of it, told apart by a 64-bit hash; new ones are merged by the vocabulary's ranks."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes and what they stand for
        self.flat, self.size, self.begin = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        data, offsets = tokens.text_bytes(column)
        begin, end = pre_tokens(data, offsets)
        hashes, first, which = np.unique(tokens.span_hashes(data, begin, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a:b] for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())])
            at = np.searchsorted(self.hashes, hashes)
        number = self.number[at][which] if len(hashes) else np.zeros(0, np.int64)
        size = self.size[number]
        filled = np.concatenate(([0], np.cumsum(size)))
        edge = np.searchsorted(begin, offsets)  # the first pre-token of each text
        return gather(self.flat, self.begin[number], size), np.diff(filled[edge])

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        learned, sizes = [self.flat], [self.size]
        for i in range(0, len(pieces), MERGED):
            ids, size = merge(pieces[i : i + MERGED], self.vocabulary)
            learned.append(ids.astype(np.int32))
            sizes.append(size.astype(np.int32))
        number = np.concatenate((self.number, np.arange(len(self.size), len(self.size) + len(pieces))))
        hashes = np.concatenate((self.hashes, hashes))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number = hashes[order], number[order]
        self.flat, self.size = np.concatenate(learned), np.concatenate(sizes)
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size


#: Kinds of bytes: white space, letters and all bytes of characters outside ASCII, digits, other marks.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[tokens.LETTER] = 1
_KIND[0x30:0x3A] = 2


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the pre-tokens of texts that lie one after the other; together they cover every byte."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    starts = np.empty(len(data), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    edges = offsets[:-1][offsets[:-1] < len(data)]
    # a single blank before anything but white space goes with what follows, unless a text ends in between
    joins = starts & (kind > 0)
    joins[0] = False
    joins[1:] &= data[:-1] == 0x20
    joins[edges] = False
    moved = np.flatnonzero(joins)
    starts[moved] = False
    starts[moved - 1] = True
    starts[edges] = True
    begin = np.flatnonzero(starts)
    return begin, np.append(begin[1:], len(data))


_ENCODERS: dict[int, BatchEncoder] = {}


def _encoder(shared) -> BatchEncoder:
    """One per Python worker and vocabulary, so that tasks of one worker share what it remembers."""
    key = shared._jid if getattr(shared, "_jid", None) is not None else id(shared)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BatchEncoder(shared.value)
    if len(_ENCODERS[key].hashes) > REMEMBERED:
        _ENCODERS[key].reset()
    return _ENCODERS[key]


@dataclass
class Attention:
    """Weights, and the tables made from them: queries, keys, values and residuals of every unit."""

    unit: np.ndarray  # subword id -> unit
    kind: np.ndarray  # subword id -> class
    share: np.ndarray  # subword id -> log of its share of the class
    marker: int  # the id that stands before and behind a text
    weights: dict[str, np.ndarray]

    def tables(self) -> tuple[np.ndarray, ...]:
        """Of every unit, and of a last one that nobody sees: query and residual, key and value with a one behind."""
        w = self.weights
        ones = np.ones((len(w["embed"]), 1))
        asks = np.hstack([w["embed"] @ w["query"] / np.sqrt(WIDTH), w["embed"], ones])
        gives = np.hstack([w["embed"] @ w["key"], w["embed"] @ w["value"], ones])
        return tuple(np.vstack([t, np.zeros(t.shape[1])]).astype(np.float32) for t in (asks, gives))

    def log_probability(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each text, its end included; ids: all texts, one after the other."""
        asks, gives = self.tables()
        query, embed, key, value = asks[:, :WIDTH], asks[:, WIDTH:-1], gives[:, :WIDTH], gives[:, WIDTH:-1]
        out, bias = self.weights["out"].astype(np.float32), self.weights["bias"].astype(np.float32)
        outward, ones = np.vstack([out, bias]), np.ones((CLASSES, 1), np.float32)
        near = self.weights["near"].astype(np.float32)
        reach = np.arange(WINDOW)[None, :] - np.arange(CONTEXT, WINDOW)[:, None]
        causal = np.where(reach <= 0, np.exp(near[np.minimum(-reach, WINDOW - 1)]), 0).astype(np.float32)
        # every text as marker, ids, marker: inputs are all but the last, targets all but the first
        full = np.full(int((size + 2).sum()), self.marker, dtype=np.int64)
        begin = np.cumsum(size + 2) - (size + 2)
        full[np.repeat(begin + 1, size) + np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)] = ids
        units, kinds, shares = self.unit[full], self.kind[full], self.share[full].astype(np.float32)
        unseen = len(asks) - 1
        windows = -(-(size + 1) // STRIDE)
        row = np.repeat(np.arange(len(size)), windows)
        start = begin[row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows))
        scored = np.empty(int((size + 1).sum()), np.float32)  # positions in order
        done = 0
        # exponentials need no shift where no logit can be large: hidden states are convex sums of values, plus one embedding
        largest = np.abs(value).max(axis=0)[:WIDTH] + np.abs(embed).max(axis=0)[:WIDTH]
        small = (largest @ np.abs(out) + np.abs(bias)).max() < 80
        steep = np.abs(query).max(axis=0) @ np.abs(key).max(axis=0) > 30
        for a in range(0, len(row), GROUP):
            own, first = row[a : a + GROUP], start[a : a + GROUP]
            place = first[:, None] + np.arange(-CONTEXT, STRIDE)
            seen = (place >= begin[own][:, None]) & (place < (begin + size + 1)[own][:, None])
            unit = np.where(seen, units[np.where(seen, place, 0)], unseen)
            asking, given = np.take(asks, unit[:, CONTEXT:], axis=0), np.take(gives, unit, axis=0)
            weight = asking[..., :WIDTH] @ given[..., :WIDTH].transpose(0, 2, 1)
            if steep:
                np.clip(weight, -30, 30, out=weight)
            np.exp(weight, out=weight)
            weight *= causal
            mixed = weight @ given[..., WIDTH:]
            hidden = asking[..., WIDTH:]
            hidden[..., :WIDTH] += mixed[..., :-1] / np.maximum(mixed[..., -1:], 1e-30)
            wanted = seen[:, CONTEXT:]
            target = place[:, CONTEXT:][wanted] + 1
            logits = hidden.reshape(-1, WIDTH + 1) @ outward if wanted.all() else hidden[wanted] @ outward
            if not small:
                logits -= logits.max(axis=1, keepdims=True)
            got = logits.reshape(-1)[np.arange(len(target)) * CLASSES + kinds[target]] + shares[target]
            got -= np.log(np.exp(logits, out=logits) @ ones)[:, 0]
            scored[done : done + len(got)] = got
            done += len(got)
        return np.add.reduceat(scored, np.cumsum(size + 1) - (size + 1), dtype=np.float64) if len(size) else np.zeros(0)


def _loss_gradients(w: dict[str, np.ndarray], u: np.ndarray, target: np.ndarray, real: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean log probability of the targets (classes) behind the units u; both have one window a row.

    real: which positions count, all by default. Windows are worked on in groups that fit into a core's cache.
    """
    n = target.size if real is None else max(int(real.sum()), 1)
    total = None
    for i in range(0, len(u), GROUP):
        part = slice(i, i + GROUP)
        d = _ascents(w, u[part], target[part], None if real is None else real[part])
        if total is None:
            total = d
        else:
            for k in d:
                total[k] += d[k]
    return {k: x / n for k, x in total.items()}


def _ascents(w: dict[str, np.ndarray], u: np.ndarray, target: np.ndarray, real: np.ndarray | None) -> dict[str, np.ndarray]:
    """Gradients of the sum of the log probabilities. Softmax weights stay exponentials, their sums divide narrow arrays."""
    dtype = w["embed"].dtype
    size, m = u.shape, u.size
    reach = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
    masked = reach < 0
    near = w["near"][np.maximum(reach, 0)]
    scale = dtype.type(1 / np.sqrt(WIDTH))
    inward = np.hstack([w["query"] * scale, w["key"], w["value"]])
    outward = np.vstack([w["out"], w["bias"]])
    x = np.ones((m, WIDTH + 1), dtype)
    x[:, :WIDTH] = np.take(w["embed"], u.ravel(), axis=0)
    qkv = x[:, :WIDTH] @ inward
    q, k = (qkv[:, j : j + WIDTH].reshape(*size, WIDTH) for j in (0, WIDTH))
    v = np.ones((*size, WIDTH + 1), dtype)  # a column of ones gives the sums of the weights
    v[..., :WIDTH] = qkv[:, 2 * WIDTH :].reshape(*size, WIDTH)
    p = q @ k.transpose(0, 2, 1)
    # exponentials need no shift where no logit can be large
    if max(p.max(), -p.min()) + np.abs(near).max() < 80:
        np.exp(p, out=p)
        p *= np.where(masked, dtype.type(0), np.exp(near))
    else:
        p += np.where(masked, dtype.type(-1e9), near)
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
    mixed = p @ v
    mass = mixed[..., WIDTH:]
    mixed = mixed[..., :WIDTH] / mass
    h = np.ones((m, WIDTH + 1), dtype)
    np.add(mixed.reshape(m, WIDTH), x[:, :WIDTH], out=h[:, :WIDTH])
    y = h @ outward
    if max(y.max(), -y.min()) >= 80:
        y -= y.max(axis=1, keepdims=True)
    np.exp(y, out=y)
    # backwards; the sign is that of ascent
    s = y @ np.ones((CLASSES, 1), dtype)
    y.reshape(-1)[np.arange(m) * CLASSES + target.ravel()] -= s[:, 0]
    s = -1 / s
    if real is not None:
        s *= real.reshape(-1, 1).astype(dtype)
    dh = (y @ w["out"].T) * s
    h *= s
    out = h.T @ y
    g = np.empty((*size, WIDTH + 1), dtype)
    g[..., :WIDTH] = dh.reshape(*size, WIDTH)
    g[..., WIDTH] = -np.einsum("ijk,ijk->ij", g[..., :WIDTH], mixed)
    g /= mass
    ds = g @ v.transpose(0, 2, 1)
    ds *= p
    dqkv = np.empty((*size, 3 * WIDTH), dtype)
    np.matmul(ds, k, out=dqkv[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., WIDTH : 2 * WIDTH])
    np.matmul(p.transpose(0, 2, 1), g[..., :WIDTH], out=dqkv[..., 2 * WIDTH :])
    dqkv = dqkv.reshape(m, 3 * WIDTH)
    dx = dh + dqkv @ inward.T
    into = x[:, :WIDTH].T @ dqkv
    d = {"query": into[:, :WIDTH] * scale, "key": into[:, WIDTH : 2 * WIDTH], "value": into[:, 2 * WIDTH :], "out": out[:-1], "bias": out[-1]}
    place = u.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
    d["embed"] = np.bincount(place.ravel(), weights=dx.ravel(), minlength=UNITS * WIDTH).reshape(UNITS, WIDTH)
    d["near"] = np.bincount(np.maximum(reach, 0).ravel(), weights=np.where(masked, 0, ds.sum(axis=0)).ravel(), minlength=WINDOW)
    return d


def fit(
    texts: list[np.ndarray], vocabulary: int, marker: int, *, counts: np.ndarray | None = None, steps: int = 250, batch: int = 96, seed: int = 3
) -> Attention:
    """An attention model from the subword ids of some texts. Without texts it is the untrained, uniform one.

    counts: how often each id occurs, if more than these texts are counted; units, classes and shares follow from it.
    """
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.concatenate(([marker], t)) for t in texts] + [[marker]]).astype(np.int64)
    if counts is None:
        counts = np.bincount(flat, minlength=vocabulary)
    order = np.argsort(-counts, kind="stable")
    unit, kind = np.empty(vocabulary, np.int64), np.empty(vocabulary, np.int64)
    unit[order] = np.where(np.arange(vocabulary) < UNITS // 2, np.arange(vocabulary), UNITS // 2 + np.arange(vocabulary) % (UNITS // 2))
    # classes of about equal mass: the most frequent ids stand alone
    mass = np.cumsum((counts + 1e-3)[order])
    kind[order] = np.minimum((mass / mass[-1] * CLASSES).astype(np.int64), CLASSES - 1)
    smooth = counts + 0.1
    share = np.log(smooth / np.bincount(kind, weights=smooth, minlength=CLASSES)[kind])
    small = lambda *shape: rng.normal(0, 0.1, shape)
    held = np.bincount(kind, weights=counts, minlength=CLASSES) + 1.0
    w = {
        "embed": small(UNITS, WIDTH), "query": small(WIDTH, WIDTH), "key": small(WIDTH, WIDTH), "value": small(WIDTH, WIDTH),
        "out": small(WIDTH, CLASSES), "bias": np.log(held / held.sum()), "near": np.zeros(WINDOW),
    }
    model = Attention(unit, kind, share, marker, w)
    if len(flat) <= WINDOW + 1:
        return model
    names, adam = list(w), Adam(*w.values(), rate=0.02)
    for step in range(steps):
        adam.rate = 0.02 * (1 - step / steps) + 0.001
        at = rng.integers(0, len(flat) - WINDOW, batch)[:, None] + np.arange(WINDOW + 1)
        d = _loss_gradients(w, unit[flat[at[:, :-1]]], kind[flat[at[:, 1:]]])
        adam.step(*(d[n] for n in names))
    return model


def learn_all(encoded: DataFrame, start: Attention, dtype: np.dtype) -> Attention:
    """The model after one pass over all texts (column ids), from the weights of `start`.

    Every task takes steps on all windows of its texts, which follow each other with the marker between them, and the
    weights of the tasks are averaged by their numbers of windows. Within a task the step size falls with the root of
    the steps. A task holds one batch of ids.
    """
    names = list(start.weights)
    shared = encoded.sparkSession.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], float]:
        model = shared.value
        w = {n: model.weights[n].astype(np.float32) for n in names}
        adam, windows = Adam(*w.values(), rate=FIRST_RATE), 0

        def steps(flat: np.ndarray, real: np.ndarray | None = None) -> int:
            n = (len(flat) - 1) // WINDOW
            unit, kind = model.unit[flat[: n * WINDOW]].reshape(n, WINDOW), model.kind[flat[1 : n * WINDOW + 1]].reshape(n, WINDOW)
            for i in range(0, n, WINDOWS):
                adam.rate = FIRST_RATE / np.sqrt(1 + adam.turn / 50)
                d = _loss_gradients(w, unit[i : i + WINDOWS], kind[i : i + WINDOWS], real)
                adam.step(*(d[k].astype(np.float32) for k in names))
            return n

        rest = np.full(1, model.marker)
        for batch in batches:
            for part in tokens.blocks(batch, "ids"):
                data, offsets = tokens.text_bytes(part.column("ids"))
                ids = np.frombuffer(data.tobytes(), dtype)
                end = offsets[1:] // np.dtype(dtype).itemsize
                rest = np.concatenate((rest, np.insert(ids.astype(np.int64), end, model.marker)))
                whole = (len(rest) - 1) // (WINDOW * WINDOWS) * WINDOW * WINDOWS
                if whole:
                    windows += steps(rest[: whole + 1])
                    rest = rest[whole:]
        most = (len(rest) - 1) // WINDOW * WINDOW
        if most:
            windows += steps(rest[: most + 1])
        if len(rest) - 1 > most:  # the last window is shorter
            last = rest[most:]
            real = np.arange(WINDOW) < len(last) - 1
            windows += steps(np.concatenate((last, np.full(WINDOW + 1 - len(last), model.marker))), real.astype(np.float32)[None])
        return list(w.values()), float(windows)

    found = averaged(encoded.select("ids"), learn)
    if found is None:
        return start
    edges = np.cumsum([start.weights[n].size for n in names])[:-1]
    weights = {n: x.reshape(start.weights[n].shape) for n, x in zip(names, np.split(found, edges))}
    return Attention(start.unit, start.kind, start.share, start.marker, weights)


def _words(part: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words per text."""
    data, offsets = tokens.text_bytes(part.column(text))
    data = tokens.LOWER[data]
    begin, end = tokens.spans(data, offsets, tokens.NOT_SPACE)
    return tokens.span_hashes(data, begin, end), np.diff(tokens.counts_per_text(begin, offsets))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word long, count long) over all words of the texts, ends of texts included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            word, count = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count, pa.int64())], ["word", "count"])

        held, n = [], 0
        for batch in batches:
            for part in tokens.blocks(batch):
                words, _ = _words(part)
                held += [words, np.full(part.num_rows, END)]
                n += len(words) + part.num_rows
                if n >= BLOCK_WORDS:
                    yield counted(held)
                    held, n = [], 0
        yield counted(held)

    return texts.select("text").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def id_counts(encoded: DataFrame, dtype: np.dtype, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the texts (column ids); one row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in tokens.blocks(batch, "ids"):
                count += np.bincount(np.frombuffer(tokens.text_bytes(part.column("ids"))[0].tobytes(), dtype), minlength=vocabulary)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["id", "count"])

    total = encoded.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[total.column("id").to_numpy()] = total.column("count").to_numpy()
    return out


def scores(docs: DataFrame, trained: Column, tokenizer_path: str, *, first_rows: int = 400, most_chars: int = 100_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens long, base_score, score double): one row per input row.

    docs: doc_id, text; the base and the attention model learn from all rows for which `trained` holds. Null texts count
    as empty: a text without words is its end alone. Without training rows all words are unknown and the model is uniform.

    About `first_rows` of these rows, chosen by a hash of the id, of at most `most_chars` characters each, only give the
    weights from which all tasks start. Subword ids are made once and stored beside the texts.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(tokenizer_path)
    size = len(vocabulary.piece_size)
    marker = max(vocabulary.added.values(), default=0)
    dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.int32)
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.blocks(batch):
                ids, n = _encoder(shared_vocabulary).encode(part.column("text"))
                flat, edge = ids.astype(dtype).tobytes(), np.concatenate(([0], np.cumsum(n))) * dtype.itemsize
                packed = pa.array([flat[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, packed], [*part.schema.names, "ids"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    docs = kept(given.mapInArrow(encode, "doc_id long, text string, trained boolean, ids binary"))
    rows = docs.where("trained")
    counts = kept(word_counts(rows))
    n, v = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    n_rows = rows.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    picked = rows.where((chance < min(1.0, first_rows / max(n_rows, 1))) & (F.length("text") <= most_chars)).limit(2 * first_rows)
    first = picked.select("doc_id", "ids").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending")]).column("ids").to_pylist()
    occur = id_counts(rows, dtype, size)
    occur[marker] += n_rows + 1
    start = fit([np.frombuffer(x, dtype) for x in first], size, marker, counts=occur)
    model = learn_all(rows, start, dtype)

    words, known = most_frequent(counts.withColumnRenamed("word", "key"), MOST_FREQUENT)
    shared = spark.sparkContext.broadcast((model, tokens.HashIndex(words.view(np.uint64), bits=22), np.append(known, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each text with what its frequent words add, and one for each other word of a text."""
        model, index, count = shared.value
        for batch in batches:
            for part in tokens.blocks(batch, "text", 4 << 20):
                data, offsets = tokens.text_bytes(part.column("ids"))
                ids, size = np.frombuffer(data.tobytes(), dtype), np.diff(offsets) // dtype.itemsize
                probability = model.log_probability(ids, size) / np.log(10)
                hashes, n_words = _words(part)
                row = np.repeat(np.arange(part.num_rows), n_words)
                # the end of each text is one more word
                hashes, row = np.concatenate((hashes, np.full(part.num_rows, END))), np.concatenate((row, np.arange(part.num_rows)))
                at = index.find(hashes)
                often = at >= 0
                logs = np.bincount(row[often], weights=np.log10(count[at[often]] + 1), minlength=part.num_rows)
                found = np.bincount(row[often], minlength=part.num_rows)
                rare, rare_row = hashes[~often], row[~often]
                order = np.lexsort((rare, rare_row))
                rare, rare_row = rare[order], rare_row[order]
                edge = np.flatnonzero(np.append(True, (np.diff(rare_row) != 0) | (np.diff(rare) != 0))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(edge, len(rare)))
                doc, text_hash = part.column("doc_id"), part.column("text_hash")
                m, k = part.num_rows, len(edge)
                take = pa.array(np.concatenate((np.arange(m), rare_row[edge])), pa.int64())
                pad = np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.take(take), text_hash.take(take),
                        pa.array(np.concatenate((tokens.mix(text_hash.to_numpy().view(np.uint64)), rare[edge])).view(np.int64)),
                        pa.array(np.concatenate((np.ones(m, bool), np.zeros(k, bool)))),
                        pa.array(np.concatenate((n_words + 1, times)), pa.int64()),
                        pa.array(np.concatenate((found, pad)).astype(np.int64)),
                        pa.array(np.concatenate((logs, pad))), pa.array(np.concatenate((probability, pad))),
                    ],
                    ["doc_id", "text_hash", "word", "whole", "n", "known", "logs", "probability"],
                )

    given = docs.select("doc_id", "text", "ids", F.xxhash64("text").alias("text_hash"))
    parts = given.mapInArrow(run, "doc_id long, text_hash long, word long, whole boolean, n long, known long, logs double, probability double")
    counted = counts.select(F.col("word").alias("w"), F.col("count").alias("c"))
    met = parts.join(counted, (F.col("word") == F.col("w")) & ~F.col("whole"), "left")
    # rows that repeat a document add up alike: divide by their number
    rows = F.sum(F.col("whole").cast("long"))
    sums = met.groupBy("doc_id", "text_hash").agg(
        rows.alias("rows"),
        F.max(F.when(F.col("whole"), F.col("n"))).alias("n_tokens"),
        F.sum(F.when(F.col("whole"), F.col("known")).when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(F.col("whole"), F.col("logs")).otherwise(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1))).alias("logs"),
        F.max(F.when(F.col("whole"), F.col("probability"))).alias("score"),
    )
    one = sums.select("doc_id", "n_tokens", (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") / F.col("rows") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), "score", "rows")
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("copy", "rows")
