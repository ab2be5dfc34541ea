"""The corpus pipeline, stage by stage, against plain versions on the smallest documents."""

import os
import re

import pytest

import corpus_pipeline
from growthlens.llm.shared import table

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def _one_of_each_group(rows):
    sets = {r.doc_id: _shingles(r.text) for r in rows}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i for i in ids if root(i) == i}


def _windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, {tuple(words[i : i + 10]) for i in range(max(len(words) - 9, 1))} if words else set()


def _holds(text, windows):
    words, _ = _windows(text)
    return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))


def test_stages_equal_plain_versions(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmark_passages", "personal_data", "tokens"]
    given = docs.collect()
    named = stages["language"](spark, docs, SF_DIR)
    assert named.columns == columns
    kept = named.collect()
    # prose is kept as it is; what goes has no letter, or no language
    assert set(kept) <= set(given) and len(kept) >= 0.95 * sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in given)
    named = spark.createDataFrame(kept, docs.schema)
    single = stages["near_duplicates"](spark, named, SF_DIR)
    rows = single.collect()
    assert {r.doc_id for r in rows} == _one_of_each_group(kept) and set(rows) <= set(kept)
    windows = set().union(*(_windows(r.text)[1] for r in table(spark, SF_DIR, "benchmark").collect()))
    clean = stages["benchmark_passages"](spark, spark.createDataFrame(rows, docs.schema), SF_DIR).collect()
    assert set(clean) == {r for r in rows if not _holds(r.text, windows)}
    hidden = stages["personal_data"](spark, spark.createDataFrame(clean, docs.schema), SF_DIR)
    assert hidden.columns == columns
    hidden = hidden.collect()
    before = {r.doc_id: r for r in clean}
    assert {r.doc_id for r in hidden} == set(before)
    for r in hidden:
        assert not EMAIL.search(r.text or "") and (r.n_chars == len(r.text) if r.text is not None else True)
        if "@" not in (before[r.doc_id].text or "") and not re.search(r"\d", before[r.doc_id].text or ""):
            assert r.text == before[r.doc_id].text


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = {r.doc_id for r in table(spark, SF_DIR, "documents").select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} < ids and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in rows)
