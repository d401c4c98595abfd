"""Distributed sums and means of array columns, and numpy batch helpers."""

from __future__ import annotations

from typing import Any, Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What one task closure may carry; anything larger is processed in slices.
BROADCAST_BYTES = 256 * 1024 * 1024
# Rows of an Arrow batch that are worked on at once: a worker's memory does not grow with the batch.
SLICE_ROWS = 1024


def _vector(column: str) -> Column:
    return array_to_vector(F.transform(column, lambda x: x.cast("double")))


def vector_sum(column: str) -> Column:
    """Element-wise sum of an array column; a JVM aggregate with map-side partial sums."""
    return vector_to_array(Summarizer.sum(_vector(column)))


def vector_mean(column: str, weight: str | None = None) -> Column:
    if weight is None:
        return vector_to_array(Summarizer.mean(_vector(column)))
    return vector_to_array(Summarizer.mean(_vector(column), F.col(weight).cast("double")))


def stack(series: pd.Series) -> np.ndarray:
    """A column of equal-length (possibly nested) arrays as one float64 array."""
    if len(series) == 0:
        return np.zeros((0, 0))
    first = series.iloc[0]
    if len(first) and isinstance(first[0], (list, np.ndarray)):
        return np.array([[np.asarray(v, dtype=np.float64) for v in row] for row in series])
    return np.stack([np.asarray(row, dtype=np.float64) for row in series])


def nested(array: np.ndarray) -> list:
    return array.tolist()


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a row-local numpy function batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield fn(batch)

    return df.mapInPandas(run, schema)


def map_slices(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """``mapInPandas`` on SLICE_ROWS rows of an Arrow batch at once: array columns become Python objects
    slice by slice, never for a whole batch. ``fn`` gets no empty frame."""
    types = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(i, SLICE_ROWS).to_pandas() for b in batches for i in range(0, b.num_rows, SLICE_ROWS))
        for frame in fn(parts):
            yield pa.RecordBatch.from_pandas(frame, schema=to_arrow_schema(types), preserve_index=False)

    return df.mapInArrow(run, types)


def dense(column: pa.Array) -> np.ndarray:
    """An Arrow column of equal-length (possibly nested) arrays as one float64 array."""
    shape = [len(column)]
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        lengths = pc.min_max(pc.list_value_length(column))
        if column.null_count or lengths["min"] != lengths["max"]:
            raise ValueError("arrays of one length are expected, and no null among them")
        shape.append(lengths["max"].as_py() or 0)
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(np.float64).reshape(shape)


def listed(array: np.ndarray) -> pa.Array:
    """The reverse of ``dense`` for an array of any number of dimensions."""
    column = pa.array(np.ascontiguousarray(array).ravel())
    for axis in range(array.ndim - 1, 0, -1):
        rows = int(np.prod(array.shape[:axis]))
        column = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * array.shape[axis], pa.int32()), column)
    return column


def add_columns(
    df: DataFrame, inputs: list[str], outputs: str, fn: Callable[..., dict[str, Any]]
) -> DataFrame:
    """Append numpy-computed columns to every row with one Arrow pass and no shuffle.

    ``fn`` gets the stacked inputs of a slice of rows and returns a dict of arrays, one for each
    output in its order. Every pass has a Python worker a task of its own; kernels that follow each
    other belong in one pass.
    """
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [outputs]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                extra = fn(*[dense(part.column(c)) for c in inputs])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[listed(np.asarray(v)) for v in extra.values()]],
                    names=[*part.schema.names, *extra],
                )

    return df.mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class LinearFuser:
    """Fusion hook: tokens [.., M, D] to fused [.., F] to label probabilities [.., C].

    Any object with the same two methods can replace it; it must be picklable.
    """

    def __init__(self, head: np.ndarray, bias: np.ndarray | None = None, mode: str = "concat"):
        self.head = np.asarray(head, dtype=np.float64)
        self.bias = np.zeros(len(self.head)) if bias is None else np.asarray(bias, dtype=np.float64)
        self.mode = mode

    def fuse(self, tokens: np.ndarray) -> np.ndarray:
        if self.mode == "mean":
            return tokens.mean(axis=-2)
        return tokens.reshape(*tokens.shape[:-2], -1)

    def probabilities(self, fused: np.ndarray) -> np.ndarray:
        return sigmoid(fused @ self.head.T + self.bias)
