"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups, keep one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, row_keys, stored, unique_ids


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


#: Row keys are 64 bits wide and sit below the number of code points.
WIDTH, LAST = str(2**64), str(2**63 - 1)


def _wide(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("decimal(38,0)")


def _keeper(points: Column, row: Column) -> Column:
    """One number that is largest for the most code points and, among those, the smallest id.
    It has a fixed width, so the aggregation stays a hash aggregation."""
    return (_wide(points) * _wide(WIDTH) + _wide(LAST) - _wide(row)).cast("decimal(38,0)")


def exact_groups(
    docs: DataFrame,
    hash128=lambda norm: F.md5(norm),
    digest=lambda norm: F.sha2(norm, 256),
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when they are identical after deleting white space. Rows are grouped by
    (128-bit hash, normalised text): the hash spreads the groups, the text in the key makes Spark
    compare the bytes, and copies collapse before the shuffle, so a group with a third of all rows
    is a row per task. Only ids, hashes and lengths are joined back.

    The row with the most code points stays, then the one with the smallest id. Null texts are
    empty texts and equal to white space. Repeated ids are separate rows: each counts in
    group_size, and exactly one row of a group is kept; null ids come after all others. An empty
    table gives an empty result. Other columns are not read.
    """
    unique = unique_ids(docs)
    keyed = row_keys(docs.select("doc_id", "text"), unique=unique)
    norm = normalised(F.col("text"))
    narrow = stored(
        keyed.select(
            "doc_id",
            "_row",
            hash128(norm).alias("_hash"),
            digest(norm).alias("text_sha256"),
            F.length(F.coalesce("text", F.lit(""))).alias("_points"),
        ),
        "exact-rows",
    )
    texts = (
        keyed.select("_row", norm.alias("_norm"), F.length(F.coalesce("text", F.lit(""))).alias("_points"))
        .groupBy(hash128(F.col("_norm")).alias("_hash"), "_norm")
        .agg(F.count("*").alias("_n"), F.max(_keeper(F.col("_points"), F.col("_row"))).alias("_keep"))
    )
    groups = stored(
        texts.groupBy("_hash", digest(F.col("_norm")).alias("text_sha256"))
        .agg(F.count("*").alias("_texts"), F.sum("_n").alias("_n"), F.max("_keep").alias("_keep"))
        .filter("_n > 1"),
        "exact-groups",
    )
    marked = _joined(narrow, groups.drop("_texts"), ["_hash", "text_sha256"])
    if groups.filter("_texts > 1").limit(1).count():
        # Different texts share both hashes: their rows are told apart by the texts themselves.
        shared = groups.filter("_texts > 1").select("_hash", "text_sha256")
        apart = keyed.select("_row", norm.alias("_norm")).join(
            narrow.join(shared, ["_hash", "text_sha256"]).drop("_points"), "_row"
        )
        members = stored(texts.join(shared.select("_hash").distinct(), "_hash"), "exact-texts")
        marked = marked.join(shared, ["_hash", "text_sha256"], "left_anti").unionByName(
            _joined(apart, members, ["_hash", "_norm"]).select(marked.columns)
        )
    kept = F.col("_row") == F.col("_keep_row")
    if unique:
        marked = marked.withColumn("keep_id", F.col("_keep_row").cast(docs.schema["doc_id"].dataType))
    else:
        marked = marked.join(narrow.select(F.col("_row").alias("_keep_row"), F.col("doc_id").alias("keep_id")), "_keep_row")
    return marked.withColumn("kept", kept).select("_row", "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _joined(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    keep = _wide(LAST) - F.col("_keep") % _wide(WIDTH)
    return rows.join(groups, on, "left").select(
        "_row",
        "doc_id",
        "_hash",
        "text_sha256",
        F.coalesce(keep.cast("long"), "_row").alias("_keep_row"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
    )


def exact_duplicates(docs: DataFrame, **hashes) -> DataFrame:
    """``exact_groups`` without the internal row key."""
    return exact_groups(docs, **hashes).drop("_row")


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group; all columns stay as they are."""
    name = free_name(docs, "_row")
    keyed = row_keys(docs, name)
    plain = keyed.select(F.col(name).alias("doc_id"), "text")
    dropped = exact_groups(plain).filter("not kept").select(F.col("doc_id").alias(name))
    return keyed.join(dropped, name, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
