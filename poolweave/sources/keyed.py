"""Rows that are found by id without a scan: bucketed, sorted tables with Bloom filters.

A stored table is dealt out to buckets by the hash of its id, each bucket is sorted by it, and the
files carry Bloom filters of the ids. Looking some ids up skips all row groups that cannot hold one;
joining two stored tables by id, or one with rows dealt out alike, moves no stored row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from ..session import scratch_path


def write_keyed(rows: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Store ``rows`` by ``key`` and return the table's name. Refuses NULL and repeated keys.

    ``buckets`` is a property of the store: tables to be joined without a shuffle have the same.
    """
    repeated = rows.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1))
    if not repeated.isEmpty():
        raise checks.AuditError(f"{key} is NULL or repeated")
    name = name or f"keyed_{uuid.uuid4().hex}"
    path = path or scratch_path(rows.sparkSession, name)
    writer = rows.repartition(buckets, key).write.mode("errorifexists").format("parquet")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return name


def locate(spark: SparkSession, name: str, key: str, ids: list) -> DataFrame:
    """The stored rows of a few ids: the filter reaches the files' ranges and Bloom filters."""
    return spark.table(name).filter(F.col(key).isin(list(ids)))


def fetch(spark: SparkSession, name: str, key: str, wanted: DataFrame) -> DataFrame:
    """The stored rows whose id is in ``wanted(key)``, which may be large: only ``wanted`` is dealt
    out, to the store's buckets."""
    return spark.table(name).join(wanted.select(key).distinct().hint("shuffle_hash"), key, "left_semi")


def paired(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """Two stores joined by id, bucket by bucket."""
    return spark.table(left).hint("merge").join(spark.table(right), key)
