"""Byte-level BPE encoding and decoding with a published vocabulary.

Texts are cut into pre-tokens; each distinct pre-token of a partition is encoded once. All of them lie in one array of
symbols. An index maps every mergeable pair to its positions, active ranks are applied in ascending order to all their
positions at once, and only the pairs beside a merge are looked up again.

A null text counts as empty. Columns named like results are replaced; all others are kept.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from growthlens.llm.tokens import blocks, release, text_bytes

# Fixed values of the byte-level format: the pattern that cuts texts, and the printable bytes that stand for themselves.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Distinct pre-tokens that a Python worker remembers; beyond that it starts anew.
REMEMBERED = 250_000
#: Largest sizes in bytes of the words that are merged together in one table.
SHORT = (8, 16, 32)
#: Bits of the table that screens pairs of symbols.
SCREEN_BITS = 19
_SPREAD, _SCREEN_SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - SCREEN_BITS)
#: Bytes of text or of ids worked on at a time; strings and positions of a block take some thirty times as much memory.
BLOCK = 1 << 19


def _byte_letters() -> dict[str, int]:
    """Letter of the format -> byte: printable bytes are themselves, the others follow from 0x100 on in their order."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The merges and tokens of a tokenizer file, as arrays; its size is that of the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, letters = file["model"]["vocab"], _byte_letters()
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.added = added
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        size = max([*ids.values(), *added.values()]) + 1
        pieces = [b""] * size
        for token, i in ids.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            pieces[i] = token.encode()
        self.piece_size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_begin = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        key = left << 32 | right
        self.rank_of = np.argsort(key)
        self.keys = key[self.rank_of]
        self.screen = np.zeros(1 << SCREEN_BITS, dtype=bool)  # most pairs don't merge
        self.screen[(key.view(np.uint64) * _SPREAD) >> _SCREEN_SHIFT] = True
        self.merged = np.array([ids["".join(m)] for m in merges], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where they don't merge."""
        key = left << 32 | right
        out = np.full(len(key), -1, dtype=np.int64)
        likely = np.flatnonzero(self.screen[(key.view(np.uint64) * _SPREAD) >> _SCREEN_SHIFT])
        some = key[likely]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[at] == some
        out[likely[hit]] = self.rank_of[at[hit]]
        return out


def merge(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the number of ids of each word.

    Short words lie in tables of one row each, in which every round merges the lowest rank of each row; the places of
    long ones are indexed by rank.
    """
    size = np.array([len(w) for w in words], dtype=np.int64)
    ids, count, least = [], np.zeros(len(words), dtype=np.int64), -1
    groups = []
    for most in (*SHORT, None):
        rows = np.flatnonzero((size > least) & (size <= most) if most is not None else size > least)
        least = most
        if len(rows):
            part = [words[i] for i in rows.tolist()]
            found, count[rows] = _merge_long(part, vocabulary) if most is None else _merge_short(part, size[rows], vocabulary)
            ids.append(found)
            groups.append(rows)
    if len(groups) == 1:
        return ids[0], count
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    rows = np.concatenate(groups) if groups else np.zeros(0, np.int64)
    begin = np.empty(len(words), dtype=np.int64)
    begin[rows] = np.cumsum(count[rows]) - count[rows]
    return gather(flat, begin, count), count


def _merge_short(words: list[bytes], size: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """`merge` for words of similar, small sizes. A round takes one symbol from each row that still merges."""
    none = np.iinfo(np.int64).max
    width = max(int(size.max()), 1)
    held = np.arange(width) < size[:, None]
    symbol = np.full((len(words), width), -1, dtype=np.int64)
    symbol[held] = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    rank = np.full((len(words), width), none)  # of the pair that begins there

    def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = vocabulary.ranks(left, right)
        return np.where((found >= 0) & (right >= 0), found, none)

    pair = held[:, 1:]
    rank[:, :-1][pair] = ranks(symbol[:, :-1][pair], symbol[:, 1:][pair])
    row, ended = np.arange(len(words)), []
    while len(row):
        at = rank.argmin(axis=1)
        low = rank[np.arange(len(row)), at]
        go = low < none
        if not go.all():
            ended.append((row[~go], symbol[~go]))
            row, symbol, rank, at, low = row[go], symbol[go], rank[go], at[go], low[go]
            if not len(row):
                break
        line = np.arange(len(row))
        symbol[line, at] = vocabulary.merged[low]
        stays = np.ones(symbol.shape, dtype=bool)
        stays[line, at + 1] = False
        symbol, rank = (x[stays].reshape(len(row), -1) for x in (symbol, rank))
        last = symbol.shape[1] - 1
        new = symbol[line, at]
        rank[line, at] = np.where(at < last, ranks(new, symbol[line, np.minimum(at + 1, last)]), none)
        inner = np.flatnonzero(at > 0)
        rank[inner, at[inner] - 1] = ranks(symbol[inner, at[inner] - 1], new[inner])
    count = np.zeros(len(words), dtype=np.int64)
    for rows, found in ended:
        count[rows] = (found >= 0).sum(axis=1)
    begin, out = np.cumsum(count) - count, np.empty(int(count.sum()), dtype=np.int64)
    for rows, found in ended:
        real = found >= 0
        out[(begin[rows][:, None] + np.arange(found.shape[1]))[real]] = found[real]
    return out, count


def _merge_long(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """`merge` by an index of places, for words of any size."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    symbol = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    n = len(symbol)
    word = np.repeat(np.arange(len(words)), size)
    # place n stands for "none" on either side
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(size) - 1
    after[ends] = n
    before[ends - size + 1] = n
    after, before = np.append(after, n), np.append(before, n)
    symbol = np.append(symbol, 1 << 31)
    alive = np.ones(n + 1, dtype=bool)
    rank = np.full(n + 1, -1, dtype=np.int64)
    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def index(at: np.ndarray) -> None:
        """Look the pairs that begin at these places up, and enter them into the index."""
        found = vocabulary.ranks(symbol[at], symbol[after[at]])
        rank[at] = found
        at, found = at[found >= 0], found[found >= 0]
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        edges = np.flatnonzero(np.diff(found, prepend=-1))
        for r, group in zip(found[edges].tolist(), np.split(at, edges[1:])):
            if r not in places:
                places[r] = []
                heapq.heappush(active, r)
            places[r].append(group)

    index(np.flatnonzero(after[:n] < n))
    while active:
        r = heapq.heappop(active)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        # where pairs overlap (aaa), every second one of a run is left out
        chained = np.zeros(len(at), dtype=bool)
        chained[1:] = after[at[:-1]] == at[1:]
        if chained.any():
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
        gone = after[at]
        symbol[at] = vocabulary.merged[r]
        alive[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        near = np.concatenate((at, before[at]))
        near = np.unique(near[near < n])
        rank[gone] = -1
        rank[near] = -1
        index(near[after[near] < n])
    kept = np.flatnonzero(alive[:n])
    return symbol[kept], np.bincount(word[kept], minlength=len(words))


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin there and have that size, one after the other."""
    return flat[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)]


class Encoder:
    """Remembers the ids of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cut = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None
        self.reset()

    def reset(self) -> None:
        self.known = {token: i for i, token in enumerate(self.vocabulary.added)}
        self.flat = np.array(list(self.vocabulary.added.values()), dtype=np.int64)
        self.size = np.ones(len(self.flat), dtype=np.int64)
        self.begin = np.arange(len(self.flat))

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.cut.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.cut.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.cut.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        if len(self.known) > REMEMBERED:
            self.reset()
        pieces, counts = [], []
        for text in texts:
            own = self.pieces(text)
            pieces += own
            counts.append(len(own))
        fresh = list(set(pieces).difference(self.known))
        if fresh:
            ids, size = merge([p.encode() for p in fresh], self.vocabulary)
            self.known.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh))))
            self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(size) - size))
            self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, ids))
        at = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        size = self.size[at]
        filled = np.concatenate(([0], np.cumsum(size)))
        edge = np.concatenate(([0], np.cumsum(np.array(counts, dtype=np.int64))))
        return gather(self.flat, self.begin[at], size), np.diff(filled[edge])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One per Python worker and vocabulary, so that tasks of one worker share what it remembers."""
    key = shared._jid if hasattr(shared, "_jid") and shared._jid is not None else id(shared)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _with(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])


def _binary(flat: np.ndarray, size: np.ndarray, width: int) -> pa.Array:
    """A binary column from one array of numbers and the count of each row."""
    offsets = np.concatenate(([0], np.cumsum(size))) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])


def _extended(df: DataFrame, without: list[str], fields: list[tuple[str, T.DataType]]) -> tuple[DataFrame, T.StructType]:
    base = df.drop(*without)
    return base, T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def encode(docs: DataFrame, tokenizer_path: str, *, text: str = "text") -> DataFrame:
    """docs with n_tokens long and ids binary: the ids of the text as little-endian unsigned 32-bit numbers.

    Strings of the file's added tokens become their id, as that tokenizer does. The file is read on the driver; tasks
    get the vocabulary, whose size the file fixes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))
    base, schema = _extended(docs, ["n_tokens", "ids"], [("n_tokens", T.LongType()), ("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in blocks(batch, text, BLOCK):
                ids, size = encoder.encode([x or "" for x in part.column(text).to_pylist()])
                yield _with(part, ["n_tokens", "ids"], [pa.array(size, pa.int64()), _binary(ids.astype("<u4"), size, 4).cast(pa.binary())])
        release()

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, *, ids: str = "ids") -> DataFrame:
    """encoded with decoded string: the bytes of its ids as UTF-8, where broken sequences become U+FFFD.

    Null ids decode to the empty text. An id outside the vocabulary raises an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))
    base, schema = _extended(encoded, ["decoded"], [("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in blocks(batch.set_column(batch.schema.get_field_index(ids), ids, batch.column(ids).cast(pa.large_binary())), ids, BLOCK):
                data, offsets = text_bytes(part.column(ids))
                numbers = np.frombuffer(data.tobytes(), dtype="<u4").astype(np.int64)
                size = vocabulary.piece_size[numbers]
                raw = gather(vocabulary.piece_bytes, vocabulary.piece_begin[numbers], size).tobytes()
                edge = np.concatenate(([0], np.cumsum(size)))[offsets // 4]
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                part = part.set_column(part.schema.get_field_index(ids), ids, part.column(ids).cast(pa.binary()))
                yield _with(part, ["decoded"], [pa.array(texts, pa.string())])
        release()

    return base.mapInArrow(run, schema)
