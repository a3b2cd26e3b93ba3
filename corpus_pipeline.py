"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from sightline.llm.common import Scratch, table
from sightline.llm.queries import MIX_ENTROPY, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id."""
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings of ``PASSAGE`` bytes that repeat anywhere."""
    return suffix_dedup.cut_repeats(docs, length=suffix_dedup.PASSAGE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is drawn, with all its columns."""
    return mixing.mix(docs, budget=1.0, entropy=MIX_ENTROPY, repetition=None, keep=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the drawn documents, in full training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("simhash", near_duplicates), ("suffix dedup", repeats), ("mixing", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written, and the next one reads it."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{k}")
    return docs


#: SQL can't express the byte strings of the third stage; the tests hold the rows against a brute-force version.
ORACLE_SQL = None
