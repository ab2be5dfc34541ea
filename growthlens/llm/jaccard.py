"""Exact Jaccard join of documents on word n-grams by rare-first prefix filtering.

Two texts of similarity t or more share one of their first n - ceil(t n) + 1 n-grams in any common order. The order here
puts n-grams that repeat within a block of text last, by their count, so prefixes consist of rare ones. The passes:

1. Every text becomes its set of n-grams; texts with one set are collapsed to the smallest id. The same pass counts the
   n-grams that repeat within blocks of a fixed number of n-grams.
2. Prefix n-grams are dealt out by n-gram and sorted by set size. Each is tied to the first of its kind still within
   the length bound, which gives a star instead of all pairs. N-grams known to be frequent are salted, and the first
   of each salt are tied again.
3. Candidates pass the positional bound, then each pair is verified once on whole sets, behind a suffix bound.
4. Pairs inside one component of the verified links need no proof. Where an n-gram occurs in several components, its
   texts are tied again in random orders, until a turn finds nothing new. Then all remaining pairs that share a prefix
   n-gram across components are proposed and verified, so no link between components is lost.

An n-gram is known by a 59-bit hash of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.llm import tokens as T
from growthlens.llm.shared import components, kept, most_frequent, small_or_any

#: N-grams counted together, and how often one must repeat among them to be taken as frequent.
BLOCK_NGRAMS, REPEATS = 4_000_000, 4
#: Entries of the list of frequent n-grams that every task gets: 16 bytes each. The rest counts as rare.
MOST_FREQUENT = 1 << 17
#: Postings of a frequent n-gram that are tied in one group.
SALT_ROWS = 512
#: Turns of random ties inside n-grams before all remaining pairs are proposed, and the groups each n-gram is split into.
MOST_TURNS, SALTS = 2, 4
#: How many n-grams before a shared one are compared for an earlier one.
LOOK_BACK = 3
#: Pairs whose sets or bitmaps are compared at a time.
PAIR_ROWS = 1024
#: Ids broadcast at most; beyond that the joins shuffle.
BROADCAST_IDS = 200_000

_ID_BITS = np.uint64(59)
_ID_MASK = np.uint64((1 << 59) - 1)


def ngram_ids(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram ids of the texts, in order, and the rows they belong to. A shorter text is one n-gram."""
    data, offsets = T.text_bytes(batch.column("text"))
    data = T.LOWER[data]
    begin, end = T.spans(data, offsets, T.NOT_SPACE)
    words = T.span_hashes(data, begin, end)
    first = T.counts_per_text(begin, offsets)
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    stop = first[1:][row]
    out = np.zeros(len(row), dtype=np.uint64)
    for k in range(n):
        at = place + k
        here = at < stop
        word = np.where(here, words[np.minimum(at, len(words) - 1)], np.uint64(k + 1)) if len(words) else out
        out = T.mix(out * np.uint64(0xD6E8FEB86659FD93) + word)
    return out >> np.uint64(5), row


class Frequent:
    """The frequent n-grams with the class of their count, as shipped to the tasks."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.index = T.HashIndex(T.mix(ids.astype(np.uint64)), bits=22)
        self.counts = counts.astype(np.int64)
        self.level = np.minimum(31, np.log2(np.maximum(self.counts, 1)).astype(np.int64) + 1).astype(np.uint64)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """Ids with the class of their count above them: sorted, they are in rare-first order."""
        at = self.index.find(T.mix(ids))
        known = at >= 0
        out = ids.copy()
        out[known] |= self.level[at[known]] << _ID_BITS
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        at = self.index.find(T.mix(keys & _ID_MASK))
        return np.where(at >= 0, self.counts[at] if len(self.counts) else 0, 0)


def _sets(batch: pa.RecordBatch, n: int, frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each row, sorted, in one array, and the number of them per row."""
    ids, row = ngram_ids(batch, n)
    if frequent is not None:
        ids = frequent.keys(ids)
    edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
    fresh = np.ones(len(ids), dtype=bool)
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:
            own = ids[a:b]
            own.sort()
            np.not_equal(own[1:], own[:-1], out=fresh[a + 1 : b])
    return ids[fresh], np.bincount(row[fresh], minlength=batch.num_rows)


def _sum_per_row(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    edge = np.concatenate(([0], np.cumsum(size)))
    return total[edge[1:]] - total[edge[:-1]]


def _profile(n: int):
    """Rows (doc_id, text_hash, n, set_a, set_b, null, null) of documents and (null, ..., ngram, count) of repeats."""

    def repeats(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(found) if found else np.zeros(0, np.uint64)
        found.clear()
        ids.sort()
        # only a run of so many has the same id so far ahead
        often = np.unique(ids[: 1 - REPEATS][ids[: 1 - REPEATS] == ids[REPEATS - 1 :]])
        count = np.searchsorted(ids, often, side="right") - np.searchsorted(ids, often)
        return often.astype(np.int64), count

    def empty(n: int) -> pa.Array:
        return pa.nulls(n, pa.int64())

    names = ["doc_id", "text_hash", "n", "set_a", "set_b", "ngram", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for part in T.blocks(batch):
                ids, size = _sets(part, n)
                a = _sum_per_row(T.mix(ids + np.uint64(1)), size).view(np.int64)
                b = _sum_per_row(T.mix(ids ^ np.uint64(0xA5A5A5A5A5A5A5A5)), size).view(np.int64)
                m = part.num_rows
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array(size, pa.int64()), pa.array(a), pa.array(b), empty(m), empty(m)]
                yield pa.RecordBatch.from_arrays(columns, names)
                found.append(ids)
                held += len(ids)
                if held >= BLOCK_NGRAMS:
                    ids, count = repeats(found)
                    yield pa.RecordBatch.from_arrays([empty(len(ids))] * 5 + [pa.array(ids), pa.array(count, pa.int64())], names)
                    held = 0
        ids, count = repeats(found)
        yield pa.RecordBatch.from_arrays([empty(len(ids))] * 5 + [pa.array(ids), pa.array(count, pa.int64())], names)
        T.release()

    return run, "doc_id long, text_hash long, n long, set_a long, set_b long, ngram long, count long"


def _prefixes(n: int, percent: int, frequent):
    """Rows (ngram, salt, doc, n, place) of the prefix n-grams of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            for part in T.blocks(batch):
                keys, size = _sets(part, n, table)
                length = np.where(size > 0, size + (-percent * size) // 100 + 1, 0)
                row = np.repeat(np.arange(len(size)), length)
                place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
                key = keys[(np.cumsum(size) - size)[row] + place]
                doc = part.column("doc_id").to_numpy()[row]
                salts = 1 + table.count(key) // SALT_ROWS
                salt = (T.mix(doc.astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int32)
                salt[salts == 1] = -1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(salt), pa.array(doc), pa.array(size[row], pa.int32()), pa.array(place, pa.int32())],
                    ["ngram", "salt", "doc", "n", "place"],
                )
        T.release()

    return run, "ngram long, salt int, doc long, n int, place int"


def _blobs(n: int, frequent):
    """Rows (doc, grams) with the whole set of each text, in rare-first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.blocks(batch):
                keys, size = _sets(part, n, frequent.value)
                edge = np.concatenate(([0], np.cumsum(size)))
                grams = [keys[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(grams, pa.binary())], ["doc", "grams"])
        T.release()

    return run, "doc long, grams binary"


def _bitmaps(n: int, frequent):
    """Rows (doc, n, bits): the size of each text's set, and a bitmap with four to eight bits for each of its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.blocks(batch):
                keys, size = _sets(part, n, frequent.value)
                hashes, edge = T.mix(keys), np.concatenate(([0], np.cumsum(size)))
                maps = []
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    bits = np.zeros(1 << max(6, (4 * (j - i)).bit_length()), dtype=bool)
                    bits[hashes[i:j] & np.uint64(len(bits) - 1)] = True
                    maps.append(np.packbits(bits, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(maps, pa.binary())], ["doc", "n", "bits"])
        T.release()

    return run, "doc long, n long, bits binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of few rows, so that few sets are held as Python objects; memory is given back at the end."""
    for batch in batches:
        for i in range(0, batch.num_rows, PAIR_ROWS):
            yield batch.slice(i, PAIR_ROWS)
    T.release()


def _possible(percent: int):
    """Keeps the pairs whose sets may reach the similarity: an n-gram whose bit the other map lacks is not shared."""

    def folded(bits: np.ndarray, size: int) -> np.ndarray:
        return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            good = np.zeros(batch.num_rows, dtype=bool)
            columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")]
            for i, (m, k, x, y) in enumerate(zip(*columns)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                least = min(len(x), len(y))
                x, y = folded(x, least), folded(y, least)
                most = min(m - int(np.bitwise_count(x & ~y).sum()), k - int(np.bitwise_count(y & ~x).sum()))
                good[i] = most * (100 + percent) >= percent * (m + k)
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return run, "a long, b long"


def _suffix_rules_out(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> bool:
    """Whether the sets differ in more than `most` n-grams for sure: halves around a pivot differ by their sizes at least."""

    def least(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or len(x) < 2 or len(y) < 2:
            return abs(len(x) - len(y))
        pivot = len(y) // 2
        at = int(np.searchsorted(x, y[pivot]))
        return least(x[:at], y[:pivot], depth - 1) + least(x[at:], y[pivot:], depth - 1)

    return least(x, y, depth) > most


def _verified(percent: int):
    """Keeps the pairs whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            xs, ys = batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist()
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(xs, ys)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if _suffix_rules_out(x, y, len(x) + len(y) - 2 * need):
                    continue
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[at] == x).sum())
                good[i] = 100 * same >= percent * (len(x) + len(y) - same)
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], ["a", "b"])

    return run, "a long, b long"


def _in_length(percent: int, small, large):
    return F.col(small) * 100 >= F.col(large) * percent


def _candidates(tied: DataFrame, percent: int) -> DataFrame:
    """Each pair once; the positions of its first shared prefix n-gram bound the overlap it can have."""
    pairs = tied.groupBy("a", "b").agg(
        F.min("place_a").alias("place_a"), F.min("place_b").alias("place_b"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")
    )
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return pairs.where(most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def ngram_links(docs: DataFrame, *, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Links between texts, and membership.

    docs: doc_id long, text string; other columns are ignored. Returns

    * membership (doc_id, n_shingles, representative), one row per input row: the representative is the smallest id
      with the same set of n-grams;
    * links (a, b) between representatives whose sets have 100 * intersection >= percent * union. They hold every link
      that joins two components; links inside a component that others already prove may be left out.

    A null or wordless text has an empty set, is its own representative and links with nothing. Rows without an id keep
    a null representative and link with nothing. Rows that repeat an id are one node.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    run, schema = _profile(n)
    seen = kept(given.mapInArrow(run, schema))
    rows = seen.where("n is not null").select("doc_id", "text_hash", "n", "set_a", "set_b")
    repeated = seen.where("ngram is not null").groupBy(F.col("ngram").alias("key")).agg(F.sum("count").alias("count"))
    frequent = spark.sparkContext.broadcast(Frequent(*most_frequent(repeated, MOST_FREQUENT)))

    same = ["n", "set_a", "set_b"]
    first = rows.where("n > 0 and doc_id is not null").groupBy(same).agg(F.min("doc_id").alias("representative"))
    member = kept(
        rows.join(first, same, "left").select(
            "doc_id", "text_hash", F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("representative", "doc_id")).alias("representative"),
        )
    )
    # rows that are not the representative of their set, once per repeated row
    copies = kept(member.where("doc_id is null or n_shingles = 0 or doc_id <> representative").select("doc_id", "text_hash").distinct())
    copies = small_or_any(copies.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")), BROADCAST_IDS)
    alone = given.join(copies, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left_anti")

    run, schema = _prefixes(n, percent, frequent)
    postings = alone.select("doc_id", "text").mapInArrow(run, schema)
    group = Window.partitionBy("ngram", "salt").orderBy("n", "doc")
    shared = postings.withColumns({"before": F.lag("doc").over(group), "after": F.lead("doc").over(group)})
    shared = kept(shared.where("salt >= 0 or before is not null or after is not null").drop("before", "after"))

    tried = kept(_candidates(_stars(shared, percent), percent))
    links = kept(_verify(tried, alone, n, percent, frequent))
    fresh = links
    for turn in range(MOST_TURNS):
        if fresh.isEmpty():
            break
        open_ = _open_postings(shared, components(links))
        more = kept(_candidates(_shuffled_ties(open_, turn, percent), percent).join(tried, ["a", "b"], "left_anti"))
        fresh = kept(_verify(more, alone, n, percent, frequent))
        tried, links = kept(tried.union(more)), kept(links.union(fresh))
    open_ = _open_postings(shared, components(links))
    rest = kept(_candidates(_across(open_, percent), percent).join(tried, ["a", "b"], "left_anti"))
    links = links.union(_verify(rest, alone, n, percent, frequent))
    return member.select("doc_id", "n_shingles", "representative"), kept(links)


def _pair(x: str, y: str) -> list:
    """Columns of a pair in the order of its ids from the structs (doc, n, place) named x and y."""
    ordered = F.col(f"{x}.doc") < F.col(f"{y}.doc")
    return [
        F.when(ordered, F.col(f"{left}.{c}")).otherwise(F.col(f"{right}.{c}")).alias(name)
        for left, right, end in ((x, y, "a"), (y, x, "b"))
        for c, name in (("doc", end), ("n", f"n_{end}"), ("place", f"place_{end}"))
    ]


def _stars(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of each posting with the first of its group and size class, and with the one before it: linear in postings."""
    own = F.struct("doc", "n", "place")
    sized = shared.withColumns({"size_class": F.floor(F.log("n") / -F.log(F.lit(percent / 100))), "own": own})
    order = Window.partitionBy("ngram", "salt").orderBy("n", "doc")
    hubs = Window.partitionBy("ngram", "salt", "size_class").orderBy("n", "doc").rowsBetween(Window.unboundedPreceding, 0)
    tied = sized.withColumn("before", F.lag("own").over(order)).withColumn("hub", F.first("own").over(hubs))
    # the hubs of the salts of one frequent n-gram are tied to each other
    tops = tied.where("salt >= 0 and hub.doc = doc")
    over = Window.partitionBy("ngram").orderBy("n", "doc")
    tops = tops.withColumn("above", F.lag("own").over(over)).where("above is not null").select(*_pair("above", "own"))
    near = tied.where("before is not null").select(*_pair("before", "own"))
    far = tied.where("hub.doc <> doc").select(*_pair("hub", "own"))
    return near.union(far).union(tops).where("a <> b")


def _open_postings(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of the n-grams that occur in more than one component, with the n-gram's largest component."""
    named = shared.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
    named = kept(named.select("ngram", "doc", "n", "place", F.coalesce("component", "doc").alias("component")))
    sizes = named.groupBy("ngram", "component").count()
    mixed = sizes.groupBy("ngram").agg(F.max_by("component", "count").alias("largest"), F.count("*").alias("kinds"))
    return kept(named.join(mixed.where("kinds > 1").drop("kinds"), "ngram"))


def _shuffled_ties(open_: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each posting with the one before it in a random order of its n-gram, where components differ: linear in
    postings, yet a text that has links in its group meets others at each of its n-grams."""
    own = F.struct("doc", "n", "place", "component")
    rows = open_.withColumns({"own": own, "minor": F.col("component") != F.col("largest"), "salt": F.pmod(F.xxhash64("doc", F.lit(turn)), F.lit(SALTS))})
    order = Window.partitionBy("ngram", "salt").orderBy(F.xxhash64("doc", "ngram", F.lit(turn)))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    of_largest = F.last(F.when(~F.col("minor"), F.col("own")), ignorenulls=True)
    tied = rows.withColumns({"before": F.lag("own").over(order), "major": of_largest.over(earlier)})
    near = tied.where("before.component <> own.component").select("before", "own")
    far = tied.where("minor and major is not null").select(F.col("major").alias("before"), "own")
    in_length = _in_length(percent, "before.n", "own.n") & _in_length(percent, "own.n", "before.n")
    return near.union(far).where(in_length).select(*_pair("before", "own"))


def _across(open_: DataFrame, percent: int) -> DataFrame:
    """All pairs that share an n-gram and are in different components: those outside an n-gram's largest component
    against every posting of the n-gram.

    A pair has to be listed at its first shared n-gram only. Where it shares one of the last few n-grams before this one
    too, or where this one comes too late to be the first of enough, it is left to an earlier one.
    """
    order = Window.partitionBy("doc").orderBy("place")
    last = [F.lag("ngram", k).over(order).alias(f"l{k}") for k in range(1, LOOK_BACK + 1)]
    posted = open_.select("ngram", "component", "largest", "doc", "n", "place", *last)
    of = lambda s: F.struct("doc", "n", "place", *(f"l{k}" for k in range(1, LOOK_BACK + 1))).alias(s)
    x = posted.where("component <> largest").select("ngram", F.col("component").alias("of_x"), of("x"))
    y = posted.select("ngram", F.col("component").alias("of_y"), "largest", of("y"))
    shared = F.lit(False)
    for k in range(1, LOOK_BACK + 1):
        shared = shared | F.coalesce(F.col(f"x.l{k}").isin(*(F.col(f"y.l{j}") for j in range(1, LOOK_BACK + 1))), F.lit(False))
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = most * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    in_length = _in_length(percent, "x.n", "y.n") & _in_length(percent, "y.n", "x.n")
    differ = (F.col("of_x") != F.col("of_y")) & ((F.col("of_y") == F.col("largest")) | (F.col("x.doc") < F.col("y.doc")))
    return x.join(y, "ngram").where(differ & in_length & enough & ~shared).select(*_pair("x", "y"))


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """The pairs (a, b) that reach the similarity. Bitmaps of the sets, a sixteenth of their size at most, rule out most
    of the others first; whole sets are made again for the texts of the pairs that are left."""

    def of_candidates(pairs: DataFrame) -> DataFrame:
        ids = kept(pairs.select("a").union(pairs.select("b")).distinct())
        return texts.join(small_or_any(ids.withColumnRenamed("a", "doc_id"), BROADCAST_IDS), "doc_id", "left_semi").select("doc_id", "text")

    def both(pairs: DataFrame, of: DataFrame) -> DataFrame:
        for end in "ab":
            pairs = pairs.join(of.select(*[F.col(c).alias(end if c == "doc" else f"{c}_{end}") for c in of.columns]), end)
        return pairs

    run, schema = _bitmaps(n, frequent)
    bits = kept(of_candidates(pairs).mapInArrow(run, schema).dropDuplicates(["doc", "n", "bits"]))
    run, schema = _possible(percent)
    left = kept(both(pairs, bits).select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, schema).distinct())
    run, schema = _blobs(n, frequent)
    sets = of_candidates(left).mapInArrow(run, schema)
    run, schema = _verified(percent)
    return both(left, sets).select("a", "b", "grams_a", "grams_b").mapInArrow(run, schema).distinct()


def jaccard_components(docs: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row.

    The component is the smallest id reachable over links; it is null for rows without an id. A null, empty or wordless
    text has 0 shingles and is a component of its own.
    """
    member, links = ngram_links(docs, n=n, percent=percent)
    # an id that repeats with different texts is one node
    several = member.groupBy("doc_id").agg(F.min("representative").alias("a"), F.max("representative").alias("b")).where("a <> b")
    bound = member.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("representative").alias("b"))
    found = components(links.union(bound))
    named = member.join(found.withColumnRenamed("node", "representative"), "representative", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "representative").alias("component_id"))


def deduplicated(docs: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """docs without the rows that another document of their component stands for: the smallest id stays.

    Of rows that repeat an id one stays. Rows without an id stay.
    """
    found = kept(jaccard_components(docs, n=n, percent=percent))
    gone = kept(found.where("component_id <> doc_id").select("doc_id").distinct())
    twice = kept(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    stay = docs.join(small_or_any(gone, BROADCAST_IDS), "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return stay
    twice = small_or_any(twice, BROADCAST_IDS)
    once = stay.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.join(twice, "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns))
