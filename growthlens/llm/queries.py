"""The registered queries of this subpackage, each with its SQL where SQL can say it in bearable time."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm import bpe, conversations, decontaminate, jaccard, langid, licenses, lm, pii, quality, rangejoin, topk, toxicity, whitening
from growthlens.llm.shared import labelled_sample, remainder, table
from growthlens.operators.common import join_back

Query = Callable[[SparkSession, str], DataFrame]

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


@query()
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


@query()
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = langid.fit_on(docs.select("doc_id", "text", "lang"), ~held_out)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query(
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, runs.n, item_id FROM runs JOIN win ON runs.n = win.n AND runs.win = win.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",").cast("binary")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    orders = F.transform("base", lambda s: s["order"])
    counts = [(F.size("base") - F.size(F.array_remove(orders, k))).cast("long").alias(f"n_{x}") for k, x in enumerate(pii.KINDS)]
    base = F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.listed(F.col("spans")).alias("spans"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out, 20_000)
    found = toxicity.detect(docs, toxicity.train(sample))
    predicted = (F.col("score") >= 0.3).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query()
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", ~held_out, 4_000)
    found = quality.score(docs, quality.train(sample))
    predicted = (F.col("score") >= 0.3).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
)
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query()
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    found = lm.scores(docs, ~held_out, f"{TOKENIZERS}/byte_bpe_50k.json")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the top folder, then the language; ids are dealt to sub-folders by thousands."""
    folder = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", folder, F.concat("doc_id", F.lit(".txt"))).alias("path"))
    return licenses.license_scan(docs).select("doc_id", "path", "license", "similarity", "origin")


@query(
    """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
)
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rangejoin.linked(table(spark, sf_dir, "embeddings"), cosine=0.95)
    return found.select("vec_id", "n_links", "component_id", "kept")


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), scale=256, components=4)


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with faults dealt out by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 takes out its
    sentence ends, 3 repeats it, 4 makes it the user's; nulls count as one space there, and in role and text."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("fault", F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20).where("fault <> 0")
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(F.col("fault") == 4, "user").otherwise(role)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query(
    r"""
WITH RECURSIVE bits AS (
  SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
dealt AS (
  SELECT named.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS fault
  FROM named, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt WHERE fault <> 0),
placed AS (
  SELECT *, CAST(row_number() OVER w AS INTEGER) AS place, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (
  SELECT *, last = '' AS blank, last <> '' AND again > 1 AS duplicate,
    last <> '' AND again = 1 AND last NOT IN ('.', '!', '?') AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS again FROM placed)),
stats AS (
  SELECT conv_id, max(place) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
-- grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a; up to two inserts go before an edit
states AS (SELECT unnest([0, 1, 2, 3]) AS st, unnest([2, 2, 3, 2]) AS nx),
ahead AS (
  SELECT st, st AS mid, '' AS letters FROM states
  UNION ALL SELECT st, nx, 'I' FROM states
  UNION ALL SELECT a.st, b.nx, 'II' FROM states a JOIN states b ON b.st = a.nx),
moves AS (
  SELECT letter, st, letters || e AS letters, 3 * length(letters) + cost AS cost, nx FROM (
    SELECT c.letter, a.st, letters, unnest(['D', 'K', 'R']) AS e, unnest([4, 0, 3]) AS cost,
      unnest([mid, CASE WHEN c.letter = 's' AND mid = 0 THEN 1 WHEN c.letter = 'u' AND mid <> 2 THEN 2
        WHEN c.letter = 'a' AND mid = 2 THEN 3 END, s.nx]) AS nx
    FROM ahead a JOIN states s ON s.st = a.mid, (SELECT unnest(['s', 'u', 'a', 'o']) AS letter) c) WHERE nx IS NOT NULL),
ways AS (
  SELECT conv_id, n + 1 AS place, st, {'cost': 3 * length(letters), 'audit': letters} AS best
  FROM stats, ahead WHERE (mid = 3 OR st = 0 AND mid = 0) AND letters <> CASE WHEN st = 3 THEN 'II' WHEN st = 0 THEN 'II' ELSE '-' END
  UNION ALL
  SELECT conv_id, place, st, min(best) FROM (
    SELECT w.conv_id, j.place, m.st, {
      'cost': (w.best).cost + m.cost + CASE WHEN j.truncated AND right(m.letters, 1) <> 'D' THEN 3 ELSE 0 END,
      'audit': m.letters || (w.best).audit} AS best
    FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.place = w.place - 1
    JOIN moves m ON m.nx = w.st AND m.letter = CASE WHEN j.initial IN ('s', 'u', 'a') THEN j.initial ELSE 'o' END
      AND (right(m.letters, 1) = 'D' OR NOT (j.blank OR j.duplicate)))
  GROUP BY conv_id, place, st),
plans AS (SELECT conv_id, (min(best)).cost AS cost, (min(best)).audit AS audit FROM ways WHERE place = 1 AND st = 0 GROUP BY conv_id),
edits AS (
  SELECT conv_id, i, letter, CAST(sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS INTEGER) AS place
  FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS i, unnest(string_split(audit, '')) AS letter FROM plans WHERE audit <> '')),
stay AS (
  SELECT e.conv_id, e.i, e.letter, j.role, j.text,
    row_number() OVER w - CASE WHEN first_value(e.letter = 'K' AND j.initial = 's') OVER w THEN 1 ELSE 0 END AS p
  FROM edits e LEFT JOIN judged j ON e.letter <> 'I' AND j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.place = e.place
  WHERE e.letter <> 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY e.i)),
whole AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN p % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS text FROM stay GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(w.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""
)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repaired_conversations(rows)


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The contract's row for every conversation of `rows`, after the damage of `damaged`."""
    reports, remaining = conversations.repair(damaged(rows))
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = join_back(join_back(every, reports, ["conv"]), conversations.digests(remaining), ["conv"])
    return found.select(
        F.col("conv").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
