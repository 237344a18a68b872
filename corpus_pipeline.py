"""Corpus pipeline: the corpus operators in sequence over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and reread as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perkframe.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from perkframe.llm.common import documents, small_batches, stage_table
from perkframe.llm.queries import BYTE_VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that are predicted toxic go."""
    return toxicity.reject_toxic(docs, toxicity.label_table(spark, sf_dir))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines aligned with an earlier document go, and documents
    that lose their last line."""
    return line_dedup.strip(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each near-duplicate group stays."""
    small_batches(spark)
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that contain a benchmark item go."""
    small_batches(spark)
    return decontaminate.remove_leaks(docs, decontaminate.benchmark_table(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token ids of every document that is left, and the digests
    of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, BYTE_VOCABULARY, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_leaks),
    ("bpe", encode),
]

#: Scores, fingerprints, alignments and merges have no SQL; tests/llm holds each
#: stage against a plain single-machine version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
