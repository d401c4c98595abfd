"""Registered queries of this subpackage; each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bitplane, bitslice, collocations, exact_dedup, langid, main_text, packing, pieces, prefix_trie, simhash, suffix_dedup, url_filter, warc
from .common import table


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, folder, "pages")))


def op6_bitslice_topk(spark: SparkSession, folder: str) -> DataFrame:
    return bitslice.nearest(table(spark, folder, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_strings(table(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.verdicts(table(spark, folder, "pages"), url_filter.fit_table(url_filter.labelled_urls(spark)))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op10_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bitplane.stored_ids(table(spark, folder, "documents"))


def op11_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_texts(table(spark, folder, "pages"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, folder, "conversations"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_packing,
        op3_sentencepiece,
        op4_simhash,
        op5_warc,
        op6_bitslice_topk,
        op7_suffix_dedup,
        op8_url_filter,
        op9_exact_dedup,
        op10_token_ids,
        op11_main_text,
        op12_prefix_trie,
        op13_collocations,
        pipeline,
    )
}

SQL: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(n) AS text_sha256
        FROM norm
        WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
    """,
}
