"""Count, mean and sum of squared deviations that can be merged without losing digits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[float, float, float]:
    """(n, mean, m2) of two parts together, by the pairwise rule."""
    n = a[0] + b[0]
    if not n:
        return a
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)


def weighted_moments(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """``keys``, n, mean, m2 of the non-NULL values; a row counts ``weight`` times.

    Every task works off its rows in Arrow batches and holds three numbers for each key; the parts
    of the tasks, a row each, are put together around their common mean.
    """
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["n double", "mean double", "m2 double"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[float, float, float]] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False):
                x, w = rows["_x"].to_numpy(np.float64), rows["_w"].to_numpy(np.float64)
                n = w.sum()
                if n:
                    mean = x[0] + (w * (x - x[0])).sum() / n
                    own = (float(n), float(mean), float((w * (x - mean) ** 2).sum()))
                    held[key] = merged(held[key], own) if key in held else own
        rows = [(*key, *of) for key, of in held.items()]
        yield pd.DataFrame(rows, columns=[*keys, "n", "mean", "m2"])

    rows = df.filter(F.col(value).isNotNull())
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    found = rows.select(*keys, F.col(value).cast("double").alias("_x"), w.alias("_w")).mapInPandas(parts, schema)
    # The parts' means are taken from the first of them, so that sums stay small.
    around = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("mean", "n", "m2"))).alias("p"))
    first = F.col("p")[0]["mean"]
    n = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["n"])
    shift = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["n"] * (x["mean"] - first)) / n
    known = around.select(*keys, "p", n.alias("n"), (first + shift).alias("mean"), shift.alias("_shift"), first.alias("_first"))
    spread = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["m2"] + x["n"] * (x["mean"] - F.col("_first") - F.col("_shift")) * (x["mean"] - F.col("_first") - F.col("_shift")))
    return known.select(*keys, "n", "mean", spread.alias("m2"))
