"""Corpus pipeline: stages over documents, each written and read again by the next.

A document that toxicity rejects goes; of each group of near copies the least id stays; documents
that hold a benchmark item go; secrets in what is left are replaced by a mark; the rest is encoded.

Null and empty texts are clean, have no near copies and no secrets, and have no tokens: they stay.
Repeated rows share their fate: all stay or all go. Ties (of ids in a group, of windows) don't arise or
go to the first. Rows without id stay unless they are toxic or hold a benchmark item. Long texts are
read whole by each stage. Empty tables give empty results; without labels nothing counts as toxic,
without a benchmark no document holds an item. All stages but the last pass further columns on as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, decontam, jaccard, secret_scan, toxicity
from marlstone.llm.common import Staging
from marlstone.session import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose chance of being toxic is at the threshold or above; null texts stay."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the least id of each group of linked texts; wordless texts and rows without id stay."""
    return jaccard.keep_one(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold an item; null texts hold none."""
    return decontam.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets replaced; texts without one, and null texts, stay as they are."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of tokens and of the text they decode to, a row for each document; null texts have none."""
    return bpe.digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scans", hide_secrets),
    ("bpe", encode),
]
#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole table of documents."""
    docs, staging = load(spark, sf_dir, "documents"), Staging(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staging.put(docs)
            if k:
                staging.drop(k)
    return docs
