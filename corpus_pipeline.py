"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing, each stage on what the last one kept.

Every stage is written as Parquet and read again, so that a lost executor costs one stage's work at most. All
stages but the last return the columns of documents, extra ones and clashing names included. Null or repeated keys
are rows of their own in every stage, and empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from authscope.llm import mixing, packing, quality, secrets, simhash
from authscope.llm.common import new_path, table
from authscope.llm.queries import PACK_VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified set of cutoffs rejects go; null and empty texts fail the base rule.
    A language without labels, null being one, has only the base rule."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (Jaccard similarity of five-word shingles of 0.8 or more, in chains) stays: the
    one with the smallest doc_id, ties by place in the files. Rows without doc_id all stay; texts without words are
    copies of each other."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are replaced by a mark; rows, and widely copied examples in them, stay. Null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as their source's target asks for, in order of training time. Null source:
    one source, ordered last. Equal rows may change places."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and the offset that hold them; each row, copies by mixing included, is a
    document of its own, a text that is null or empty one piece with the end id."""
    return packing.pack(docs, public_tokenizers.path(PACK_VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Labels' exact tails, SimHash components and tokenizers can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
