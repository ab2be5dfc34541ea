"""A corpus pipeline: language, near duplicates, benchmark passages, personal data, tokens.

Every stage takes the documents that the one before has kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm import bpe, decontaminate, jaccard, langid, pii
from growthlens.llm.queries import TOKENIZERS
from growthlens.llm.shared import table
from growthlens.session import checkpoint_dir

#: A document whose best language has less than this share of its words' probability is of no language.
LEAST_LANGUAGE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of no language; the model learns from all labelled rows."""
    found = langid.identify(docs, langid.fit_on(docs.select("doc_id", "text", "lang"), F.lit(True)))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more."""
    return jaccard.deduplicated(docs, n=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    found = pii.redact(pii.find(docs, pii.train(docs.select("doc_id", "text"))))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): packed token ids, and whether they decode to the text."""
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    decoded = bpe.decode(bpe.encode(docs, path), path)
    return decoded.select(
        "doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can't express the fitted models and the tokenizer; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored in the shared folder and read again by the next stage."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
