"""Bootstrap comparison of arms, budget curves, verdicts and cross-run tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import with_scalars
from ..session import cut_lineage
from .ranking_metrics import recall_rows


def paired_rows(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Per evaluable id the recall of both arms and their difference."""
    a = recall_rows(left, [k]).filter(F.col("positives") > 0)
    b = recall_rows(right, [k]).filter(F.col("positives") > 0)
    return a.select("id", (F.col(f"hits_{k}") / F.col("positives")).alias("left")).join(
        b.select("id", (F.col(f"hits_{k}") / F.col("positives")).alias("right")), "id"
    ).withColumn("diff", F.col("right") - F.col("left"))


def paired_columns(cells: DataFrame, left: str, right: str, k: int) -> DataFrame:
    """``paired_rows`` of two score columns of the same cells, which are read and grouped once."""
    packed = cells.groupBy("id").agg(
        F.sum("y").cast("double").alias("positives"), F.collect_list(F.struct("ord", F.col("y").cast("int").alias("y"), left, right)).alias("r")
    )

    def recall(column: str):
        best = F.array_sort(F.transform("r", lambda x: F.struct((-x[column]).alias("k"), x["ord"].alias("ord"), x["y"].alias("y"))))
        return F.aggregate(F.slice(best, 1, k), F.lit(0), lambda a, x: a + x["y"]).cast("double") / F.col("positives")

    out = packed.filter(F.col("positives") > 0).select("id", recall(left).alias("left"), recall(right).alias("right"))
    return out.withColumn("diff", F.col("right") - F.col("left"))


def _poisson_cdf(terms: int = 16) -> list[float]:
    """Cumulative probabilities of Poisson(1) for 0, 1, 2, ..."""
    out, total, term = [], 0.0, math.exp(-1.0)
    for n in range(terms):
        total += term
        out.append(total)
        term /= n + 1
    return out


POISSON_CDF = _poisson_cdf()
_LOW = np.uint64(0xFFFFFFFF)


def _mix32(h: np.ndarray, last: int = 16) -> np.ndarray:
    """Avalanche rounds of a 32-bit hash, held in unsigned 64-bit numbers."""
    # The multipliers of the public 32-bit finaliser.
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(2246822507)) & _LOW
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(3266489909)) & _LOW
    return h ^ (h >> np.uint64(last))


def poisson_weights(ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """[rows, draws] Poisson(1) counts that depend on (seed, id, draw) only."""
    golden = np.uint64(2654435769)
    key = ids.astype(np.int64).view(np.uint64)
    h = _mix32((key & _LOW) ^ ((np.uint64(seed) * golden) & _LOW)) ^ (key >> np.uint64(32))
    step = (np.arange(draws, dtype=np.uint64) * golden) & _LOW
    u = (_mix32((h[:, None] + step[None]) & _LOW).astype(np.float64) + 0.5) / 2.0**32
    return np.searchsorted(POISSON_CDF, u, side="right").astype(np.float64)


def bootstrap_draws(pairs: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, mean difference): resampling with Poisson(1) weights in one pass.

    Weights come from a vectorised hash inside the task, which adds up its rows to one
    number per draw; the shuffle carries ``tasks x draws`` rows whatever the row count.
    """

    def kernel(batches):
        top, bottom = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.iloc[start : start + 2048]
                w = poisson_weights(part["id"].to_numpy(), draws, seed)
                top += part["diff"].to_numpy() @ w
                bottom += w.sum(axis=0)
        yield pd.DataFrame({"draw": range(draws), "top": top, "bottom": bottom})

    parts = pairs.select("id", "diff").mapInPandas(kernel, "draw int, top double, bottom double")
    return parts.groupBy("draw").agg((F.sum("top") / F.sum("bottom")).alias("mean_diff"))


#: Rows of a bucket of the exact bootstrap, about; draws of a bucket that are made at once.
BUCKET, AT_ONCE = 50_000, 16


def _takes(bounds: np.ndarray, draws: int, items: int, seed: int) -> Callable[[int], np.ndarray]:
    """How many of each draw's ``items`` fall into a bucket, given the running counts of buckets.

    The way down a tree over the buckets: at each node a binomial splits what it has between its
    halves. A node's numbers depend on (seed, node) alone, so all buckets below it agree on them.
    The way to the bucket asked last is kept: buckets that are asked in order share most of it.
    """
    path = [(0, len(bounds) - 1, np.full(draws, items, np.int64))]

    def taken(bucket: int) -> np.ndarray:
        while not path[-1][0] <= bucket < path[-1][1]:
            path.pop()
        low, high, left = path[-1]
        while high - low > 1:
            middle = (low + high) // 2
            size = bounds[high] - bounds[low]
            share = (bounds[middle] - bounds[low]) / size if size else 0.0
            first = np.random.default_rng([seed, low, high]).binomial(left, share)
            low, high, left = (low, middle, first) if bucket < middle else (middle, high, left - first)
            path.append((low, high, left))
        return left

    return taken


def _taken(bounds: np.ndarray, bucket: int, draws: int, items: int, seed: int) -> np.ndarray:
    return _takes(bounds, draws, items, seed)(bucket)


def multinomial_draws(pairs: DataFrame, draws: int, seed: int, bucket: int = BUCKET) -> DataFrame:
    """(draw, items, mean difference): every draw takes exactly as many rows as there are, each
    equally likely and with replacement.

    Rows are hashed by id into buckets of a bounded size. A tree of binomials says how many items of
    a draw come from a bucket, and inside it they are drawn one by one; so draws are multinomial as
    a whole, though no task holds more than a bucket and a batch. A task gets a range of buckets in
    order and adds them up to one row a draw. The driver sees the buckets' sizes.
    """
    stored = cut_lineage(pairs.select("id", "diff", F.xxhash64(F.lit(seed), "id").alias("_hash")))
    rows = stored.count()
    count = max(1, -(-rows // bucket))
    spread = stored.select("id", "diff", F.pmod("_hash", F.lit(count)).cast("int").alias("bucket"))
    sizes = np.zeros(count + 1, np.int64)
    held = spread.groupBy("bucket").agg(F.count("*").alias("n")).toPandas()
    sizes[held["bucket"].to_numpy() + 1] = held["n"].to_numpy()
    bounds = np.cumsum(sizes)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = _takes(bounds, draws, rows, seed)
        totals, items, rest = np.zeros(draws), np.zeros(draws, np.int64), None

        def draw(own: int, values: np.ndarray) -> None:
            wanted = taken(own)
            rng = np.random.default_rng([seed, own])
            for first in range(0, draws, AT_ONCE):
                n = wanted[first : first + AT_ONCE]
                drawn = values[rng.integers(0, len(values), int(n.sum()))]
                ends = np.cumsum(n)
                total = np.append(0.0, np.cumsum(drawn))
                totals[first : first + AT_ONCE] += total[ends] - total[ends - n]
            items[:] += wanted

        for batch in batches:
            if not len(batch):
                continue
            batch = batch if rest is None else pd.concat([rest, batch])
            own, values = batch["bucket"].to_numpy(), batch["diff"].to_numpy()
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            for first, end in zip(starts[:-1], starts[1:]):
                draw(int(own[first]), values[first:end])
            rest = batch.iloc[starts[-1] :]
        if rest is not None:
            draw(int(rest["bucket"].iloc[0]), rest["diff"].to_numpy())
            yield pd.DataFrame({"draw": np.arange(draws), "total": totals, "items": items})

    ordered = spread.repartitionByRange("bucket").sortWithinPartitions("bucket", "id").select("bucket", "diff")
    parts = ordered.mapInPandas(kernel, "draw int, total double, items long")
    return parts.groupBy("draw").agg(F.sum("items").alias("items"), (F.sum("total") / F.sum("items")).alias("mean_diff"))


def paired_interval(pairs: DataFrame, draws: int, seed: int, weights: str = "multinomial") -> DataFrame:
    """One row: mean of the draws and the percentile 95 % interval.

    ``weights`` is ``multinomial`` (exact draws of as many rows as there are) or ``poisson``
    (independent Poisson(1) counts, one pass without a shuffle of rows).
    """
    if weights not in ("multinomial", "poisson"):
        raise ValueError(f"unknown weights {weights!r}")
    make = multinomial_draws if weights == "multinomial" else bootstrap_draws
    return make(pairs, draws, seed).agg(
        F.avg("mean_diff").alias("mean"),
        F.percentile("mean_diff", F.lit(0.025)).alias("low"),
        F.percentile("mean_diff", F.lit(0.975)).alias("high"),
    )


def verdict(interval: DataFrame, achievable: DataFrame, margin: float = 3.0) -> DataFrame:
    """unresolved / marginal / resolvable from the ceiling interval and the range."""
    half = (F.col("high") - F.col("low")) / F.lit(2.0)
    ratio = F.when(half > 0, F.col("achievable") / half)
    return with_scalars(interval, achievable).select(
        "low",
        "high",
        "achievable",
        half.alias("half_width"),
        ratio.alias("ratio"),
        F.when(F.col("low") <= 0, "unresolved")
        .when(ratio < margin, "marginal")
        .otherwise("resolvable")
        .alias("verdict"),
    )


def normalised_gain(interval: DataFrame, achievable: DataFrame) -> DataFrame:
    """Gain of an arm over random as a share of the achievable range."""
    return with_scalars(interval, achievable).select(
        F.col("mean").alias("gain"),
        "low",
        "high",
        F.when(F.col("achievable") > 0, F.col("mean") / F.col("achievable")).alias("normalised"),
        ((F.col("low") > 0) | (F.col("high") < 0)).alias("beats_noise"),
    )


def budget_curve(curve: DataFrame, ceiling: DataFrame, arm: str | None = None) -> DataFrame:
    """Share of the gap between the smallest budget and the ceiling that is closed.

    ``curve`` has one row per round (labeled, value), and where ``arm`` names a column, per arm; every
    arm starts from its own smallest budget. ``ceiling`` is one row.
    """
    start = F.min_by("value", "labeled").alias("start")
    span = F.col("ceiling") - F.col("start")
    started = with_scalars(curve, curve.agg(start)) if arm is None else curve.join(curve.groupBy(arm).agg(start), arm)
    return with_scalars(started, ceiling).select(
        *([] if arm is None else [arm]),
        "labeled",
        "value",
        F.when(span > 0, (F.col("value") - F.col("start")) / span).alias("gap_closed"),
    )


def curve_area(curve: DataFrame, arm: str = "arm") -> DataFrame:
    """Trapezoid area over the labeled range; one row per arm and round comes in."""
    w = Window.partitionBy(arm).orderBy("labeled")
    seg = curve.withColumn(
        "_a",
        (F.col("value") + F.lag("value").over(w)) / F.lit(2.0) * (F.col("labeled") - F.lag("labeled").over(w)),
    )
    span = F.greatest(F.max("labeled") - F.min("labeled"), F.lit(1))
    return seg.groupBy(arm).agg(
        F.when(F.count("*") > 1, F.coalesce(F.sum("_a"), F.lit(0.0)) / span)
        .otherwise(F.first("value"))
        .alias("normalised_area")
    )


def compare_curves(curve: DataFrame) -> DataFrame:
    """Area per arm; arms measured by different primary metrics are an error."""
    seen = [r["metric"] for r in curve.select("metric").distinct().limit(2).collect()]
    if len(seen) > 1:
        raise ValueError(f"cannot compare arms with different primary metrics: {sorted(seen)}")
    return curve_area(curve)


def flatten_metrics(df: DataFrame) -> DataFrame:
    """Nested metric structs to dotted columns; arrays are dropped."""

    def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()):
        for f in schema.fields:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path)
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                yield path

    cols = [
        F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema)
    ]
    return df.select(*cols)


def metric_matrix(runs: list[DataFrame]) -> DataFrame:
    """Union of flattened runs with the union of their columns in sorted order."""
    from .checks import union_all

    out = union_all([flatten_metrics(r) for r in runs])
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)])


def timing_table(records: DataFrame) -> DataFrame:
    """Round, labeled count and seconds per phase out of nested round records."""
    have = set(records.select("timing.*").columns)

    def sec(*names: str):
        found = [F.col(f"timing.{n}") for n in names if n in have]
        return F.coalesce(*found, F.lit(0.0)) if found else F.lit(0.0)

    counts = [F.col(c) for c in ("labeled_count", "labeled_before_query") if c in records.columns]
    return records.select(
        "round_index",
        F.coalesce(*counts, F.lit(0)).alias("labeled"),
        sec("joint_training_sec", "classifier_training_sec").alias("training_sec"),
        sec("method_training_sec").alias("method_sec"),
        F.col("timing.round_total_sec").alias("total_sec"),
    )
