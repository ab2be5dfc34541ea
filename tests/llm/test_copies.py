"""Jaccard join and decontamination against brute force."""

import itertools
import re

import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from growthlens.llm import decontaminate, jaccard
from growthlens.llm.shared import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


def edited(text, at):
    words = text.split(" ")
    words[at] = f"edit{at}"
    return " ".join(words)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(documents, n, percent):
    base = [prose(i, 120) for i in range(3)]
    texts = [None, "", "  \n", "one two", "ONE two", "one two three"]
    texts += [t for b in base for t in (b, b.upper(), *(edited(b, k) for k in range(3, 110, 9)), *(edited(edited(b, k), 115 - k) for k in range(5, 50, 7)))]
    texts += [prose(99, 4000), edited(prose(99, 4000), 2000), "hot " * 300, "hot " * 301]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(texts), n=n, percent=percent).collect()}
    assert got == brute(texts, n, percent)


def test_repeats_are_counted_and_memory_is_given_back(monkeypatch):
    import pyarrow as pa

    texts = [" ".join(f"w{i}x{j}" for j in range(20_000)) for i in range(20)] + ["a b c d e f"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(25)), pa.array(range(25)), pa.array(texts)], ["doc_id", "text_hash", "text"])
    sizes = []
    release = jaccard.T.release
    monkeypatch.setattr(jaccard.T, "release", lambda: (sizes.append(1), release()))
    run, _ = jaccard._profile(4)
    rows = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    assert sorted(r["count"] for r in rows if r["ngram"] is not None) == [5, 5, 5]
    assert len(sizes) == 1 and sorted(r["doc_id"] for r in rows if r["ngram"] is None) == list(range(25))


def test_frequent_ngrams_are_salted_without_loss(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 3)
    base = prose(5, 80)
    texts = [edited(base, k) for k in range(40)] + [edited(edited(base, k), 79 - k) for k in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(texts)).collect()}
    assert got == brute(texts, 4, 85)


def test_repeated_ids_missing_ids_and_empty_tables(documents):
    texts, ids = [prose(1, 50), prose(1, 50), prose(2, 50), prose(2, 50), prose(3, 50)], [4, 4, 9, None, 9]
    rows = sorted(jaccard.jaccard_components(documents(texts, ids)).collect(), key=str)
    assert {(r.doc_id, r.component_id) for r in rows} == {(4, 4), (9, 9), (None, None)} and len(rows) == 5
    assert jaccard.jaccard_components(documents([])).count() == 0
    kept = jaccard.deduplicated(documents(texts, ids))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "9", "None"] and kept.columns == documents([]).columns


def test_components_of_long_paths(spark):
    links = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert components(links).select("component").distinct().collect() == [(0,)]


def brute_hits(text, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    own, hit, found = words(text), set(), set()
    for i, item in items:
        w = words(item)
        for window in [w[k : k + size] for k in range(max(1, len(w) - size + 1))] if w else []:
            for k in range(len(own) - len(window) + 1):
                if own[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found |= {str(i)} if i is not None else set()
    return len(own), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark, documents):
    items = [(1, prose(50, 25)), (10, "Étude NE change pas"), (2, prose(50, 25)), (3, None), (4, "..."), (None, "secret words")]
    texts = [None, "", "...", prose(50, 25), "x " + prose(50, 12).upper() + "! y", prose(50, 9), "étude ne change pas", "Étude, ne-change PAS",
             "secret-words secret words", prose(7, 3000) + " " + prose(50, 25) + " " + prose(50, 25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([*texts, texts[3]], [*range(len(texts)), 3])
    rows = decontaminate.contamination(docs, bench).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r.doc_id], items, 10)
        assert r.contaminated == (r.n_hit > 0) and r.score == "x"
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
