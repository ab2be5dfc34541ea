"""BPE, personal data, language, quality, toxicity, licences and language-model scores on small fixtures."""

import collections
import math
import os
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from growthlens.llm import bpe, decontaminate, langid, licenses, lm, pii, quality, toxicity, topk
from growthlens.llm.shared import averaged

TOKENIZER = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
ODD = [None, "", " ", "\n\n", "a" * 5000, "é語🙂 'll don't <|endoftext|> x", "one", prose(3, 2000), prose(3, 2000), "\t1.2.3.4 　x\x1cy"]


def test_bpe_equals_the_library_and_round_trips(documents):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(TOKENIZER)
    encoded = bpe.encode(documents(ODD), TOKENIZER)
    rows = {r.doc_id: r for r in bpe.decode(encoded, TOKENIZER).collect()}
    for i, text in enumerate(ODD):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(rows[i].ids), "<u4").tolist() == want and rows[i].n_tokens == len(want)
        assert rows[i].decoded == (text or "") == library.decode(want, skip_special_tokens=False) and rows[i].score == "x"
    assert bpe.decode(bpe.encode(documents([]), TOKENIZER), TOKENIZER).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, n[::-1]))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(n) <= 19 and luhn, "phone": 10 <= len(n) <= 15}
            if good[kind]:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns(documents):
    texts = [t or "" for t in ODD] + [
        "🙂 a.b@c-d.e.f_x@y.z and +1 (310) 555-4510, 4111 1111 1111 1111 10.0.0.1", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.004",
        "4111111111111111 4111-1111-1111-1112 +12 3456 789 0+1234567890123456", "1-" * 3000 + "1", "9" * 20000, "a." * 2000 + "@b.c",
        " ".join(f"u{i}@h{i}.org" for i in range(600)), "@@ a@ @b.c a@b",
    ]
    docs = documents([*texts, None])
    rows = {r.doc_id: r for r in pii.redact(pii.find(docs, pii.train(docs))).collect()}
    for i, text in enumerate(texts):
        want = brute_spans(text)
        assert [(s.begin, s.order, s.stop) for s in rows[i].base] == want, text[:60]
        assert {(s.begin, s.order, s.stop) for s in rows[i].spans} >= set(want)
        parts, at = [], 0
        for s in rows[i].spans:
            if s.begin >= at:
                parts += [text[at : s.begin], f"[{pii.KINDS[s.order].upper()}]"]
            at = max(at, s.stop)
        assert rows[i].text == "".join(parts) + text[at:]
    assert rows[len(texts)].text is None and rows[len(texts)].spans == []
    assert pii.find(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_personal_data_is_learned_from_all_rows(documents, monkeypatch):
    texts = [f"call +49 30 {1000000 + 37 * i} or write to a{i}@b.org, item {i}-{i}" if i % 3 else f"no. {i}" for i in range(300)]
    held, keep = [], pii.kept
    monkeypatch.setattr(pii, "kept", lambda df: held.append(keep(df)) or held[-1])
    docs = documents(texts, [i * 7 for i in range(300)])
    assert pii.train(docs).trees
    said = docs.select(pii.proposals(F.col("text")).alias("p")).collect()
    assert held[0].agg(F.sum("times")).first()[0] == sum(len(r.p) for r in said) > 600
    assert held[0].select("half").distinct().count() == 2 and held[0].count() < 600


def test_languages(documents):
    words = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "ktory bylby najwiekszy przykladem zeby"}
    texts = [" ".join(np.random.default_rng(i).permutation(words["ab"[i % 2] * 2].split())) for i in range(60)]
    docs = documents(texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    model = langid.fit_on(docs, F.col("doc_id") < 40)
    rows = langid.identify(documents([*texts, None, "", "12 !?", "lorem\n" * 3000]), model).collect()
    want = [("aa", "bb")[i % 2] for i in range(60)] + ["und"] * 3 + ["aa"]
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.doc_id)] == want
    assert all(0 <= r.score <= 1 for r in rows)
    row, found, _ = model.label(__import__("pyarrow").array(["lorem ipsum dolor ktory bylby najwiekszy"]))
    assert [model.languages[k] for k in found.argmax(axis=1)] == ["aa"] * 3 + ["bb"] * 3
    assert [r.lang_pred for r in langid.identify(docs.limit(2), langid.fit_on(docs, F.lit(False))).collect()] == ["und"] * 2


def test_languages_are_learned_from_all_rows(spark, monkeypatch):
    words = {"en": "the cat sat on that mat", "fr": "le chat est sur la table"}
    # the odd words stand in rows that are too long for the first weights
    rows = [(i, f"{words[x]} {i}", x) for i in range(80) for x in words] + [(900 + i, "zyqo wexa " * 30, "fr") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    counted = []
    average = langid.averaged

    def seen(rows, learn):
        counted.extend(learn([b])[1] for b in rows.toArrow().to_batches())
        return average(rows, learn)

    monkeypatch.setattr(langid, "averaged", seen)
    model = langid.fit_on(docs, F.lit(True), per_language=5, most_chars=100)
    assert sum(counted) == sum(len(re.findall("[a-z]+", t)) for _, t, _ in rows)
    found = langid.identify(spark.createDataFrame([(1, "zyqo wexa"), (2, "the cat")], "doc_id long, text string"), model)
    assert [r.lang_pred for r in found.orderBy("doc_id").collect()] == ["fr", "en"]
    alone = langid.fit([words["en"], words["fr"]], ["en", "fr"])
    assert model.label(lm.pa.array(["zyqo wexa"]))[1][0, 1] > alone.label(lm.pa.array(["zyqo wexa"]))[1][0, 1]


def test_quality_and_toxicity_learn_and_take_odd_texts(spark, documents):
    rows = [(i, prose(i, 60) + (" vile foul" if i % 3 == 0 else ""), int(i % 2)) for i in range(200)]
    rows = [(i, t if good else "!! ".join(t.upper().split()), good) for i, t, good in rows]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.train(sample)
    out = {r.doc_id: r.score for r in quality.score(documents([*(t for _, t, _ in rows), *ODD]), model).collect()}
    assert all(isinstance(s, float) and 0 <= s <= 1 for s in out.values())
    assert np.mean([(out[i] >= 0.3) == bool(good) for i, _, good in rows]) > 0.95
    assert len(quality.label_lines(documents(["a\nb\nc"]), model).first().bad) == 3
    toxic = toxicity.train(sample.withColumn("label", (F.col("doc_id") % 3 == 0).cast("int")))
    found = {r.doc_id: r for r in toxicity.detect(documents([*(t for _, t, _ in rows), *ODD]), toxic).collect()}
    assert np.mean([(found[i].score >= 0.3) == (i % 3 == 0) for i, _, _ in rows]) > 0.95
    assert any("vile" in rows[0][1].lower()[p.begin : p.stop] for p in found[0].passages)
    none = sample.limit(0)
    assert quality.score(documents(ODD), quality.train(none)).count() == len(ODD) == toxicity.detect(documents(ODD), toxicity.train(none)).count()


def test_segments_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 14))
        place = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
        gain = rng.integers(1, 6, len(place)).astype(float)
        full = np.full(n, -1.5)
        full[place] = gain
        best = max(full[a:b].sum() for a in range(n) for b in range(a + 1, n + 1))
        found = toxicity.segments(place, gain, 1.5)
        assert max(s for *_, s in found) == pytest.approx(best)
        assert all(s == pytest.approx(full[a : b + 1].sum()) and s > 0 for a, b, s in found)
        assert all(x[1] < y[0] for x, y in zip(found, found[1:]))


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(400)]
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 20), (404, rows[0][1]), (405, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 50 == 0)
    got = {(r.query_id, r.rank): (r.id, r.score) for r in found.collect()}
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v and len(v) == 20 and np.isfinite(v).all()}
    want = {}
    for i in (i for i in good if i % 50 == 0):
        order = sorted(((-int(good[i] @ v), j) for j, v in good.items() if j != i))[:5]
        want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(order)}
    assert got == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License.\n"), ("a/b/x.py", "code"), ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
            ("a/b/c/y.py", None), ("a/b/c/z.py", "# Licensed under CC BY-NC 4.0.\ncode"), ("d/w.py", "no licence to speak of"), (None, "x"), ("d/w.py", "no licence to speak of")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("term", F.lit(1))
    got = sorted((str(r.path), r.license, r.origin, r.term) for r in licenses.license_scan(files).collect())
    assert got == sorted([("a/LICENSE", "MIT", "own", 1), ("a/b/x.py", "MIT", "inherited", 1), ("a/b/c/LICENSE", "Apache-2.0", "own", 1), ("a/b/c/y.py", "Apache-2.0", "inherited", 1),
                          ("a/b/c/z.py", "CC-BY-NC-4.0", "own", 1), ("d/w.py", None, "none", 1), ("None", None, "none", 1), ("d/w.py", None, "none", 1)])
    assert licenses.license_scan(files.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 18, 20])
def test_language_model_base_and_probability(documents, monkeypatch, most):
    monkeypatch.setattr(lm, "MOST_FREQUENT", most)
    texts = [*ODD, *(prose(i, 80) for i in range(30))]
    docs = documents([*texts, texts[9]], [*range(len(texts)), 9])
    rows = lm.scores(docs, F.col("doc_id") % 3 != 2, TOKENIZER).collect()
    assert len(rows) == len(texts) + 1
    ascii_ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ascii_)), None]
    counts = collections.Counter(w for i, t in [*enumerate(texts), (9, texts[9])] if i % 3 != 2 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words = split(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0 and math.isfinite(r.score)


def test_tokens_hold_little_of_a_batch_at_a_time():
    """The function that a task runs, on a batch of 8 MB of distinct words; a block of 4 MB took more than 200 MB."""
    rng = np.random.default_rng(5)
    words = rng.integers(97, 123, (1_000_000, 8)).astype(np.uint8)
    words[:, 7] = 32
    flat = words.tobytes().decode()
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array([flat[i : i + 4000] for i in range(0, len(flat), 4000)])], ["text"])
    held = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x, _jid=None))))
    held.drop, held.schema, held.mapInArrow = lambda *names: held, SimpleNamespace(fields=[]), lambda run, schema: run
    encode, decode = bpe.encode(held, TOKENIZER), bpe.decode(held, TOKENIZER)
    texts, most = [], []
    tracemalloc.start()
    for part in encode(iter([batch])):
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.reset_peak()
        for back in decode(iter([part])):
            texts += back.column("decoded").to_pylist()
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert "".join(texts) == flat
    assert max(most) < 130e6


def test_short_words_merge_like_long_ones(monkeypatch):
    vocabulary, rng = bpe.Vocabulary(TOKENIZER), np.random.default_rng(3)
    words = [w.encode() for w in prose(4, 30000).split()] + [b"", b"a", b"a" * 31, b"a" * 32, b"a" * 33, b" " * 40, b"ab" * 200]
    words += [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in rng.integers(0, 40, 3000)]
    ids, size = bpe._merge_long(words, vocabulary)
    looked = []
    monkeypatch.setattr(vocabulary, "ranks", lambda *a, f=vocabulary.ranks: looked.append(1) or f(*a))
    found, sizes = bpe.merge([w for w in words if len(w) <= 32], vocabulary)
    assert len(looked) < 250  # some rounds, not every distinct rank
    whole = bpe.merge(words, vocabulary)
    assert (whole[0] == ids).all() and (whole[1] == size).all()
    assert (sizes == size[[len(w) <= 32 for w in words]]).all() and len(found) == sizes.sum()
    assert [len(x) for x in bpe.merge([], vocabulary)] == [0, 0]


@pytest.mark.parametrize("large", [1.0, 60.0])
def test_attention_gradients_are_those_of_the_log_probability(large):
    rng = np.random.default_rng(2)
    shapes = {"embed": (lm.UNITS, lm.WIDTH), "query": (lm.WIDTH,) * 2, "key": (lm.WIDTH,) * 2, "value": (lm.WIDTH,) * 2, "out": (lm.WIDTH, lm.CLASSES), "bias": (lm.CLASSES,), "near": (lm.WINDOW,)}
    w = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    w["bias"] *= large
    w["near"] *= large
    u, target = rng.integers(0, 50, (lm.GROUP + 3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (lm.GROUP + 3, lm.WINDOW))

    def value():
        x, i = w["embed"][u], np.arange(lm.WINDOW)
        p = x @ w["query"] @ (x @ w["key"]).transpose(0, 2, 1) / math.sqrt(lm.WIDTH) + w["near"][np.maximum(i[:, None] - i, 0)]
        p = np.where(i[:, None] >= i, np.exp(p - p.max(axis=2, keepdims=True)), 0)
        y = (p / p.sum(axis=2, keepdims=True) @ (x @ w["value"]) + x) @ w["out"] + w["bias"]
        top = y.max(axis=2)
        return (np.take_along_axis(y, target[..., None], 2)[..., 0] - top - np.log(np.exp(y - top[..., None]).sum(axis=2))).mean()

    got = lm._loss_gradients(w, u, target)
    for k, at in (("embed", (u[0, 0], 3)), ("query", (1, 2)), ("key", (4, 0)), ("value", (5, 6)), ("out", (7, 8)), ("bias", (9,)), ("near", (2,))):
        was, step = w[k][at], 1e-5
        w[k][at] = was + step
        high = value()
        w[k][at] = was - step
        low = value()
        w[k][at] = was
        assert got[k][at] == pytest.approx((high - low) / (2 * step), rel=1e-4, abs=1e-9)


def test_span_hashes_are_one_polynomial_at_any_size():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    begin = np.array([0, 5, 70_000, 200_000, 270_000])
    end = np.array([3, 66_000, 200_000, 265_000, 300_000])
    alone = [lm.tokens.span_hashes(data[a:b], np.zeros(1, np.int64), np.array([b - a]))[0] for a, b in zip(begin, end)]
    assert (lm.tokens.span_hashes(data, begin, end) == np.array(alone)).all() and len(set(alone)) == 5
    mixed = np.array([3, 0, 4, 2, 1])
    assert (lm.tokens.span_hashes(data, begin[mixed], end[mixed]) == np.array(alone)[mixed]).all()


def test_attention_windows_score_each_id_once():
    ids = np.arange(200) % 50
    model = lm.fit([ids] * 3, 60, 59, steps=60)
    one = model.log_probability(np.concatenate([ids, ids[:1], ids[:0]]), np.array([200, 1, 0]))
    assert one[0] > 200 * math.log(1 / 60) / 2 and (one < 0).all()
    assert model.log_probability(ids, np.array([200]))[0] == pytest.approx(one[0], rel=1e-5)


def test_attention_learns_from_all_rows(documents, monkeypatch):
    docs = documents([prose(i % 40, 200) for i in range(600)]).repartition(3)
    counted = []
    count = lm.id_counts
    monkeypatch.setattr(lm, "id_counts", lambda *a: counted.append(count(*a)) or counted[-1])
    learned = {r.doc_id: r.score for r in lm.scores(docs, F.col("doc_id") % 3 != 2, TOKENIZER, first_rows=0).collect()}
    encoder = lm.BatchEncoder(lm.Vocabulary(TOKENIZER))
    ids, _ = encoder.encode(lm.pa.array([prose(i % 40, 200) for i in range(600) if i % 3 != 2], lm.pa.large_string()))
    own = np.bincount(ids, minlength=len(counted[0]))
    own[max(encoder.vocabulary.added.values(), default=0)] += 401
    assert (counted[0] == own).all()
    # no text is drawn for the first weights: what is better than them was learned from the rows
    monkeypatch.setattr(lm, "learn_all", lambda encoded, start, dtype: start)
    before = {r.doc_id: r.score for r in lm.scores(docs, F.col("doc_id") % 3 != 2, TOKENIZER, first_rows=0).collect()}
    assert sum(learned.values()) > sum(before.values()) + 600


def test_weights_are_averaged_by_what_they_count(spark):
    def learn(batches):
        x = np.array([v for b in batches for v in b.column("x").to_pylist()], dtype=float)
        return [np.full((2, 1000), x.mean() if len(x) else 0.0), np.arange(500.0)], float(len(x))

    rows = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    got = averaged(rows.repartition(3), learn)
    assert got == pytest.approx(np.concatenate((np.full(2000, 9.5), np.arange(500.0))))
    assert averaged(rows.limit(0), learn) is None


def test_blocks_without_a_word(spark):
    texts = [(i, t, "en") for i, t in enumerate(["!!! ???", "", None, " 1 2 ", "\n"] * 4)]
    model = langid.fit(["the cat sat on the mat", "le chat est sur la table"], ["en", "fr"])
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(2)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()} == {("und", 0.0)}


def test_clashing_columns_are_kept(spark):
    text = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, text, "a", "b", "c/d.txt", "e", "f", "g")], "doc_id long, text string, r_id string, R_hash string, path string, own_path string, d_hash string, of string")
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    found = decontaminate.contamination(df, items).first()
    assert found["contaminated"] and [found[c] for c in df.columns] == list(df.first())
    found = licenses.license_scan(df).first()
    assert found["origin"] == "none" and [found[c] for c in df.columns] == list(df.first())
