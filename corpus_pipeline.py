"""A corpus pipeline of five stages, each on what the one before it kept.

Documents without a known language go; exact copies go; of each group of near duplicates one stays;
strings of 200 bytes that repeat are cut out; what is left is packed into token sequences. Each
stage is written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from poolweave.llm import exact_dedup, langid, packing, simhash, suffix_dedup
from poolweave.llm.common import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter, and those that the network is not sure about."""
    return langid.with_known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest and first stays."""
    return exact_dedup.without_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more of their five-word shingles, the first stays."""
    return simhash.without_near_duplicates(docs, words=5, similarity=0.8)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text loses what repeats elsewhere; no document is dropped, though its text may be empty."""
    return suffix_dedup.without_repeated_strings(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("language", known_language),
    ("exact", exact_copies),
    ("near", near_copies),
    ("repeats", repeated_strings),
    ("packing", sequences),
]

#: Neither a trained network nor token ids can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
