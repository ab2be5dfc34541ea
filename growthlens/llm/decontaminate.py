"""Benchmark passages inside documents, found by a prefix-filtered join in SQL functions only.

A window of an item occurs in a document only if its rarest word does, so that word is the whole necessary prefix. The
words of the benchmark are ordered by how often the documents hold them; every document word is matched against the
rarest words only, and the window is compared at the place its prefix fixes, within the bounds of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.llm.shared import fresh, kept, small_or_any

#: What lies between words: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a benchmark table (words, windows) that are broadcast at most; beyond that the joins shuffle.
BROADCAST_ROWS = 100_000


def lower_ascii(text: Column) -> Column:
    """Lower case for A-Z alone; `lower` does the same, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: str) -> Column:
    """Lower-cased words; null text has none."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(F.col(text)), GAP, -1), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, window array): all runs of `size` words of an item; a shorter item is one window."""
    listed = items.select("item_id", words("text").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    placed = listed.select("item_id", "words", F.explode(starts).alias("start"))
    return placed.select("item_id", F.slice("words", F.col("start") + 1, F.lit(size)).alias("window")).distinct()


def document_words(docs: DataFrame, reach: int) -> DataFrame:
    """(doc_id, text_hash, place, word, near, near_place): every word with up to `reach` words on either side."""
    listed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("words"))
    placed = listed.select("doc_id", "text_hash", "words", F.posexplode("words").alias("place", "word"))
    first = F.greatest(F.col("place") - reach, F.lit(0))
    return placed.select(
        "doc_id",
        "text_hash",
        "place",
        "word",
        F.slice("words", first + 1, F.lit(2 * reach + 1)).alias("near"),
        (F.col("place") - first).alias("near_place"),
    )


def occurrences(docs: DataFrame, items: DataFrame, *, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, start, window) for every place where a window occurs, and the windows of the items."""
    windows = kept(item_windows(items, size))
    distinct = windows.select("window").distinct()
    placed = distinct.select("window", F.posexplode("window").alias("offset", "word"))
    vocabulary = kept(placed.select("word").distinct())
    counted = document_words(docs, 0).select("word").join(small_or_any(vocabulary, BROADCAST_ROWS), "word").groupBy("word").count()
    # windows with a word that no document holds can't occur; the inner join leaves that word, and them, out below
    ranked = placed.join(counted, "word").groupBy("window").agg(
        F.min(F.struct("count", "word", "offset")).alias("rarest"), F.count("*").alias("held")
    )
    prefixes = ranked.where(F.col("held") == F.size("window")).select("window", "rarest.word", "rarest.offset")
    prefixes = small_or_any(kept(prefixes), BROADCAST_ROWS)
    at = F.col("near_place") - F.col("offset")
    same = (at >= 0) & (F.slice("near", F.greatest(at, F.lit(0)) + 1, F.size("window")) == F.col("window"))
    found = document_words(docs, size - 1).join(prefixes, "word").where(same)
    return found.select("doc_id", "text_hash", (F.col("place") - F.col("offset")).alias("start"), "window"), windows


def contamination(docs: DataFrame, items: DataFrame, *, size: int = 10) -> DataFrame:
    """docs with n_words, n_hit, n_items long, items array of string (sorted item ids) and contaminated boolean.

    Words inside any occurrence of a window are hit. Null and wordless texts have no words and no hits; items without
    words match nothing, and items without an id count towards hits only. Rows that repeat a document get its result
    each. Columns named like results are replaced; all others are kept. With an empty benchmark nothing is hit.
    """
    found, windows = occurrences(docs.select("doc_id", "text"), items, size=size)
    found = kept(found)
    key = ["doc_id", "text_hash"]
    # hit words: the union of intervals, each counted from where those before it end
    spans = found.groupBy(*key, "start").agg((F.col("start") + F.max(F.size("window"))).alias("stop"))
    earlier = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    hit = spans.withColumn("new", F.greatest(F.col("stop") - reached, F.lit(0)))
    hit = hit.groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    listed = found.select(*key, "window").distinct().join(small_or_any(windows, BROADCAST_ROWS), "window")
    listed = listed.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    base = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated")
    r_id, r_hash, d_hash = fresh(base, "r_id", "r_hash", "d_hash")
    results = hit.join(listed, key).select(F.col("doc_id").alias(r_id), F.col("text_hash").alias(r_hash), "n_hit", "items")
    base = base.withColumns({"n_words": F.size(words("text")).cast("long"), d_hash: F.xxhash64("text")})
    results = small_or_any(kept(results), BROADCAST_ROWS)
    joined = base.join(results, F.col("doc_id").eqNullSafe(F.col(r_id)) & (F.col(d_hash) == F.col(r_hash)), "left")
    return joined.drop(r_id, r_hash, d_hash).withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"),
            "items": F.coalesce("items", F.array().cast("array<string>")),
            "n_items": F.coalesce(F.size("items"), F.lit(0)).cast("long"),
            "contaminated": F.col("n_hit").isNotNull(),
        }
    )
