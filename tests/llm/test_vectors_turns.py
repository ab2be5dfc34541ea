"""Range join, whitening and conversation repair against plain versions."""

import hashlib
import itertools
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlens.llm import conversations, rangejoin, whitening
from growthlens.llm.queries import ORACLES, QUERIES, repaired_conversations

VECTORS = "vec_id long, embedding array<float>, n_links string, __key string, row int"


def _plain_links(rows, cosine):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [None if not ok(v) else (lambda y: y / np.sqrt((y * y).sum()))(np.array(v, float) / np.abs(np.array(v, float)).max()) for _, v in rows]
    links = [
        [j for j in range(len(rows)) if j != i and a is not None and unit[j] is not None and len(a) == len(unit[j]) and a @ unit[j] >= cosine]
        for i, a in enumerate(unit)
    ]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return out


def _vectors(seed, plain=60):
    rng = np.random.default_rng(seed)
    near = lambda v, e: (v + e * rng.standard_normal(len(v))).tolist()
    hub, loose = rng.standard_normal(6), rng.standard_normal(6)
    rows = [rng.standard_normal(6).tolist() for _ in range(plain)]
    rows += [near(hub, 0.02) for _ in range(80)] + [near(hub, 0.12) for _ in range(60)] + [near(loose, 0.2) for _ in range(60)]
    rows += [hub.tolist()] * 5 + [(hub * 1e30).tolist(), (hub * 1e-30).tolist()]
    rows += [None, [], [0.0] * 6, [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [float("inf"), 1, 1, 1, 1, 1], [1.0, 0.0], [1.0, 0.01]]
    rows = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in rows]
    ids = rng.permutation(len(rows)).tolist()
    ids[3], ids[70], ids[150] = None, None, ids[200]
    return list(zip(ids, rows)) + [(None, None), (5, [0.0, 3.0]), (None, [0.0, 2.0])]


@pytest.mark.parametrize("cell,shard,stream", [(4096, 4096, 65_536), (20, 16, 32)])
def test_range_join_equals_all_pairs(spark, monkeypatch, cell, shard, stream):
    for name, value in (("CELL", cell), ("SHARD", shard), ("STREAM", stream)):
        monkeypatch.setattr(rangejoin, name, value)
    rows = _vectors(3)
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], VECTORS)
    out = rangejoin.linked(df, cosine=0.95)
    assert out.columns == ["vec_id", "embedding", "__key", "row", "n_links", "component_id", "kept"]
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()]
    assert sorted(got, key=key) == sorted(_plain_links(rows, 0.95), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.collect())
    assert max(n for _, n, _ in got) > 100


def test_cells_hold_every_neighbour():
    rng = np.random.default_rng(1)
    u = rangejoin.units(rng.standard_normal((400, 3)))
    r = float(np.sqrt(2 - 2 * 0.95))
    cells = rangejoin.Cells(rangejoin.pivots(u, 12, r), r, np.full(12, 2.0))
    d = cells.distances(u)
    cells.radius = np.array([d[d.argmin(axis=1) == c].min(axis=1).max(initial=0) for c in range(12)])
    home, _, row, cell, _ = cells.place(d)
    inside = set(zip(row.tolist(), cell.tolist())) | set(enumerate(home.tolist()))
    linked = np.argwhere(u @ u.T >= 0.95)
    assert all((j, home[i]) in inside for i, j in linked)
    assert len(row) < 400 * 11 / 2  # most cells are not visited


@pytest.mark.parametrize("width", [1, 2, 5, 64])
@pytest.mark.parametrize("few", [0, 32, 10**9])
def test_bounds_in_blocks_lose_no_link(monkeypatch, width, few):
    monkeypatch.setattr(rangejoin, "FEW", few)
    rng = np.random.default_rng(width)
    a = rng.standard_normal((700, width))
    b = np.concatenate((a[:300] + 0.2 * rng.standard_normal((300, width)), rng.standard_normal((400, width)), a[:5]))
    weight, node = rng.integers(1, 5, len(b)), np.arange(len(b)) + 10_000
    node[-5:] = np.arange(5)  # the same nodes don't link with themselves
    block = rangejoin.Block(np.arange(len(a)), np.arange(len(a)), a, 0.95)
    own, other = block.meet(node, node, b, weight)
    linked = (rangejoin.units(a) @ rangejoin.units(b).T >= 0.95) & (np.arange(len(a))[:, None] != node[None])
    assert (block.links == linked @ weight).all() and linked.any()
    assert sorted(other) == sorted(node[linked.any(axis=0)])


def test_blocks_compare_few_pairs_without_structure(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 2000, 64))
    compared, cosines = [], rangejoin.Block._cosines
    monkeypatch.setattr(rangejoin.Block, "_cosines", lambda self, u, own, other: compared.append(len(own)) or cosines(self, u, own, other))
    block = rangejoin.Block(np.arange(2000), np.arange(2000), a, 0.95)
    block.meet(np.arange(2000) + 5000, np.arange(2000), b, np.ones(2000, np.int64))
    assert compared and sum(compared) < len(a) * len(b) / 1000


def test_range_join_of_nothing(spark):
    for rows in ([], [(1, None), (2, [])]):
        out = rangejoin.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
        assert [tuple(r)[2:] for r in out] == [(0, i, True) for i, _ in rows]


# whitening


@pytest.mark.parametrize("kind", ["random", "equal", "pairs", "near", "rank"])
def test_eigenvectors_equal_a_library(kind):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    values = {
        "random": rng.random(30), "equal": np.full(30, 2.0), "pairs": np.repeat(np.arange(15.0), 2),
        "near": 1 + 1e-13 * np.arange(30), "rank": np.append([3.0, 1.0], np.zeros(28)),
    }[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.eigen(a, 6)
    np.testing.assert_allclose(e, np.linalg.eigvalsh(a)[::-1][:6], atol=1e-13)
    np.testing.assert_allclose(a @ v, v * e, atol=1e-12)
    np.testing.assert_allclose(v.T @ v, np.eye(6), atol=1e-13)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((200, 5)) @ np.diag([3, 2, 1, 0.5, 0.1])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += rows[:40] + [(900, rows[0][1])] * 30 + [(None, rows[1][1])]
    odd = [(901, None), (902, []), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [float("nan")] * 5), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, component int")
    out = [tuple(r) for r in whitening.whitened(df).collect()]
    x = np.floor(256 * np.array([v for _, v in rows], dtype=np.float32).astype(float)).astype(int)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    centred = u - s / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1], w[:, ::-1]
    assert len(out) == 4 * len(rows)
    want = {}
    for (i, _), own, dev in zip(rows, (x - s / n) @ w[:, :4] / np.sqrt(e[:4]), ((n * x - s) ** 2).sum(axis=1)):
        want.setdefault((i, dev), own)
    signs = {}
    for i, k, count, dev, value, explained, error in out:
        own = want[i, dev][k - 1]
        if abs(own) > 1e-6:
            assert signs.setdefault(k, np.sign(own * value)) == np.sign(own * value)
        assert abs(abs(own) - abs(value)) < 1e-9 and count == n and error < 1e-9
        assert explained == pytest.approx(e[k - 1] / e.sum(), rel=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])] * 3])
def test_whitening_without_directions(spark, rows):
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_whitening_of_huge_numbers_and_few_directions(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [5.0, 1.0])]
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r["component"] for r in out] == [1, 1, 1]
    assert min(r["deviation"] for r in out) >= 0
    assert max(r["deviation"] for r in out) == 2**63 - 1


# conversations


def _cheapest(word):
    """Least (cost, audit) over all edit scripts, by exhaustive search."""
    best = [(1 << 60, "")]

    def go(at, state, cost, audit, inserts):
        if (cost, audit) > best[0] and cost > best[0][0]:
            return
        if at == len(word) and state in (0, 3):
            best[0] = min(best[0], (cost, audit))
        if inserts < 3:
            go(at, {0: 2, 1: 2, 2: 3, 3: 2}[state], cost + 3, audit + "I", inserts + 1)
        if at == len(word):
            return
        symbol = word[at]
        go(at + 1, state, cost + 4, audit + "D", 0)
        if symbol == "x":
            return
        extra = 3 if symbol.isupper() else 0
        legal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state].get(symbol.lower())
        if legal:
            go(at + 1, legal, cost + extra, audit + "K", 0)
        go(at + 1, {0: 2, 1: 2, 2: 3, 3: 2}[state], cost + extra + 3, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return best[0]


def test_audits_equal_exhaustive_search():
    rng = np.random.default_rng(4)
    words = ["".join(w) for n in range(4) for w in itertools.product("suaoSUAOx", repeat=n)]
    words += ["".join(rng.choice(list("suaoUAx"), 6)) for _ in range(60)]
    automaton, total = conversations.Suffixes(), 0
    for word in sorted(w[::-1] for w in words):
        assert automaton.read(word) == _cheapest(word[::-1]), word[::-1]
        total += len(word)
    assert automaton.made < total  # suffixes are shared


def _plain_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if fault == 0:
                continue
            text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(fault, text)
            own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, word, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            word += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            if fault:
                counts[fault] += 1
        turns = [t for t, *_ in own if t is not None]
        cost, audit = _cheapest(word)
        remaining, at, place = [], 0, 0
        for edit in audit:
            place += edit != "D"
            first = remaining[0].startswith("s") if remaining else False
            name = "user" if (place - first) % 2 else "assistant"
            if edit == "I":
                remaining.append(f"{name}:")
                continue
            if edit != "D":
                remaining.append(f"{own[at][1] if edit == 'K' else name}:{own[at][2]}")
            at += 1
        initials = [r[1][:1] for r in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(remaining).encode()).hexdigest(),
        )
    return out


def test_repair_equals_plain_version(spark):
    rng = np.random.default_rng(8)
    texts = ["Hi there.", "Yes!", "no end", "", " \n\t", "Hi there.", "  spaces after?  ", "\x0b.\x0c", None, "ü.", "x" * 40_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "uncle", "User"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(int(rng.integers(1, 8))):
            role = roles[int(rng.integers(len(roles)))] if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            number = None if rng.random() < 0.05 else turn * int(rng.integers(1, 3))
            rows.append((conv, number, role, texts[int(rng.integers(len(texts)))]))
    rows += [rows[3], rows[3], (77, None, None, None), (78, 2**62, "user", "a."), (78, -(2**62), "user", "b.")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, word int")
    out = repaired_conversations(df).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in out} == _plain_repair(rows)
    assert len(out) == len({r[0] for r in rows})


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye."), (1, 4, "tool", "Bye!")]
    reports, remaining = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r["place"], r["role"], r["text"], r["edit"]) for r in remaining.collect())
    report = reports.first()
    assert (report["duplicate"], report["cost"], report["audit"]) == (1, 10, "KIKDKR")
    assert got == [(1, "system", "Be kind.", "K"), (2, "user", "", "I"), (3, "assistant", "Hello.", "K"), (4, "user", "Bye.", "K"), (5, "assistant", "Bye!", "R")]


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired_conversations(df).count() == 0


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", ["op11_embedding_near_dedup", "op13_conversation_repair"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    out = QUERIES[name](spark, SF_DIR)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(tuple(r) for r in out.select(names).collect()) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_whitening_query_is_white(spark):
    out = QUERIES["op12_embedding_whitening"](spark, SF_DIR)
    rows = out.groupBy("component").agg(F.avg("whitened").alias("m"), F.avg(F.pow("whitened", F.lit(2))).alias("v"), F.max("identity_error").alias("e"))
    assert [(r["component"], round(r["v"], 6), round(abs(r["m"]), 6)) for r in rows.orderBy("component").collect()] == [(k, 1.0, 0.0) for k in range(1, 5)]
    assert rows.agg(F.max("e")).first()[0] < 1e-4
