"""What the operators of this subpackage share: tables, row keys and stored intermediate results."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolweave.session import scratch_path

#: The characters of [\x20\x09-\x0D], which the duplicate operators treat as white space.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends in files that all
    executors see, and the rows are computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unique_ids(docs: DataFrame) -> bool:
    """Whether doc_id has neither nulls nor repeats."""
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    return odd.limit(1).count() == 0


def row_keys(docs: DataFrame, column: str = "_row", unique: bool | None = None) -> DataFrame:
    """``docs`` with a unique, non-null LONG ``column`` that ascends with doc_id.

    It is doc_id where that is unique; otherwise the rows are numbered in the order of doc_id,
    nulls last, and stored, so that every later pass sees the same numbers.
    """
    if unique_ids(docs) if unique is None else unique:
        return docs.withColumn(column, F.col("doc_id").cast("long"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last())
    return stored(ordered.withColumn(column, F.monotonically_increasing_id()), "rows")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fields(df: DataFrame, column: str, more: str) -> T.StructType:
    """The schema of one column of ``df`` and what the DDL text ``more`` adds to it."""
    return T.StructType([df.schema[column], *T.StructType.fromDDL(more).fields])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _give_back() -> None:
    """Return what Arrow and the C library hold but do not use to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def given_back(kernel: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel``, after which a Python worker, which lives on for other tasks, is small again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            _give_back()

    return run


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part has more than ``most_bytes`` of ``column``, or else one row."""
    if not batch.num_rows:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    yield batch.slice(first)
