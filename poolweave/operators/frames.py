"""Irregular events to carry-forward step frames, and their normalisation.

The dense grid is never joined. Observed bins are reduced first, a seed row with the
channel's normal value is put at bin -1, and each observation is then expanded over the
steps it stays valid for. Statistics are taken from (value, number of steps) pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bin_count, bin_id
from ..functions.moments import weighted_moments
from . import checks
from .events import category_codes

STD_FLOOR = 1e-7


@dataclass(frozen=True)
class Channel:
    name: str
    normal: str
    values: tuple[str, ...] = ()

    @property
    def categorical(self) -> bool:
        return bool(self.values)


# Channel names, normal values and category lists of the step frame.
CHANNELS = (
    Channel("Capillary refill rate", "0.0", ("0.0", "1.0")),
    Channel("Diastolic blood pressure", "59.0"),
    Channel("Fraction inspired oxygen", "0.21"),
    Channel(
        "Glascow coma scale eye opening",
        "4 Spontaneously",
        ("To Pain", "3 To speech", "1 No Response", "4 Spontaneously", "None", "To Speech", "Spontaneously", "2 To pain"),
    ),
    Channel(
        "Glascow coma scale motor response",
        "6 Obeys Commands",
        (
            "1 No Response", "3 Abnorm flexion", "Abnormal extension", "No response", "4 Flex-withdraws",
            "Localizes Pain", "Flex-withdraws", "Obeys Commands", "Abnormal Flexion", "6 Obeys Commands",
            "5 Localizes Pain", "2 Abnorm extensn",
        ),
    ),
    Channel(
        "Glascow coma scale total",
        "15",
        ("11", "10", "13", "12", "15", "14", "3", "5", "4", "7", "6", "9", "8"),
    ),
    Channel(
        "Glascow coma scale verbal response",
        "5 Oriented",
        (
            "1 No Response", "No Response", "Confused", "Inappropriate Words", "Oriented", "No Response-ETT",
            "5 Oriented", "Incomprehensible sounds", "1.0 ET/Trach", "4 Confused", "2 Incomp sounds",
            "3 Inapprop words",
        ),
    ),
    Channel("Glucose", "128.0"),
    Channel("Heart Rate", "86"),
    Channel("Height", "170.0"),
    Channel("Mean blood pressure", "77.0"),
    Channel("Oxygen saturation", "98.0"),
    Channel("Respiratory rate", "19"),
    Channel("Systolic blood pressure", "118.0"),
    Channel("Temperature", "36.6"),
    Channel("Weight", "81.0"),
    Channel("pH", "7.4"),
)
CATEGORIES = {c.name: c.values for c in CHANNELS if c.categorical}
CATEGORICAL = list(CATEGORIES)


def frame_columns(channels: tuple[Channel, ...] = CHANNELS) -> list[str]:
    """Data columns in channel order, then one mask column per channel."""
    data: list[str] = []
    for c in channels:
        data.extend([f"{c.name}->{v}" for v in c.values] or [c.name])
    return data + [f"mask->{c.name}" for c in channels]


def bin_values(
    events: DataFrame, stays: DataFrame, step: float = 1.0, max_steps: int | None = None, mode: str = "union"
) -> DataFrame:
    """Observed bins: latest number per continuous channel; set of categories seen in the
    bin per categorical channel (``mode='latest'`` keeps only the last one).

    Returns (stay_id, variable, bin, bins, num, cats).
    """
    length = bin_count(F.col("los_hours"), step)
    if max_steps is not None:
        length = F.least(length, F.lit(max_steps))
    sized = stays.select("stay_id", length.alias("bins"))
    binned = events.join(sized, "stay_id").withColumn("bin", bin_id(F.col("hours"), step))
    binned = binned.filter((F.col("bin") >= 0) & (F.col("bin") < F.col("bins")))
    code, table = category_codes(CATEGORIES)
    binned = binned.withColumn("_code", code)
    bit = F.expr("shiftleft(1L, _code)")
    # Times are unique per channel here, so the hour alone decides which value is last.
    masks = F.bit_or(bit) if mode == "union" else F.max_by(bit, "hours")
    grouped = binned.groupBy("stay_id", "variable", "bin").agg(
        F.max("bins").alias("bins"),
        F.max_by("num", "hours").alias("_num"),
        masks.alias("_mask"),
    )
    seen = F.filter(
        F.try_element_at(table, F.col("variable")), lambda e: e["bit"].bitwiseAND(F.col("_mask")) != 0
    )
    return grouped.select(
        "stay_id",
        "variable",
        "bin",
        "bins",
        F.when(F.col("_mask").isNull(), F.col("_num")).alias("num"),
        F.when(F.col("_mask").isNotNull(), F.array_sort(F.transform(seen, lambda e: e["txt"]))).alias("cats"),
    )


def channel_findings(events: DataFrame, channels: tuple[Channel, ...] = CHANNELS) -> DataFrame:
    """Categories outside the configured list, and text in a continuous channel."""
    known = F.lit(False)
    for c in channels:
        if c.categorical:
            known = known | ((F.col("variable") == c.name) & F.col("txt").isin(list(c.values)))
    is_text = F.col("variable").isin([c.name for c in channels if c.categorical])
    return checks.count_findings(
        events,
        {
            "unknown category": is_text & ~known,
            "text in a continuous channel": ~is_text & F.col("num").isNull(),
            "unknown channel": ~F.col("variable").isin([c.name for c in channels]),
        },
    )


def validity_runs(
    binned: DataFrame,
    stays: DataFrame,
    step: float = 1.0,
    max_steps: int | None = None,
    channels: tuple[Channel, ...] = CHANNELS,
) -> DataFrame:
    """Each observation with the half-open run of steps it is valid for.

    A seed per (stay, channel) carries the normal value from step 0 to the first
    observation. Partitioned by stay once; a stay holds at most steps x channels rows. ``max_steps`` cuts
    the frames only where the caller names it.
    """
    length = bin_count(F.col("los_hours"), step)
    if max_steps is not None:
        length = F.least(length, F.lit(max_steps))
    table = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("variable"),
                (F.lit(None) if c.categorical else F.lit(float(c.normal))).cast("double").alias("num"),
                (F.array(F.lit(c.normal)) if c.categorical else F.lit(None)).cast("array<string>").alias("cats"),
            )
            for c in channels
        ]
    )
    seeds = (
        stays.select("stay_id", length.alias("bins"))
        .filter(F.col("bins") > 0)
        .withColumn("c", F.explode(table))
        .select("stay_id", "c.variable", F.lit(-1).alias("bin"), "bins", "c.num", "c.cats")
    )
    both = seeds.unionByName(binned).repartition("stay_id")
    order = Window.partitionBy("stay_id", "variable").orderBy("bin")
    runs = both.withColumn("until", F.coalesce(F.lead("bin").over(order), F.col("bins")))
    runs = runs.withColumn("since", F.greatest("bin", F.lit(0)))
    return runs.filter(F.col("until") > F.col("since")).select(
        "stay_id", "variable", "bin", "since", "until", "num", "cats"
    )


def frames_long(runs: DataFrame) -> DataFrame:
    """One row per (stay, channel, step) with the carried value and the observed flag."""
    return runs.withColumn("step", F.explode(F.sequence("since", F.col("until") - 1))).select(
        "stay_id",
        "variable",
        "step",
        "num",
        "cats",
        (F.col("step") == F.col("bin")).alias("observed"),
    )


def frames_wide(
    runs: DataFrame, channels: tuple[Channel, ...] = CHANNELS, on_bad: str = "error"
) -> DataFrame:
    """(stay, step, x): data columns in channel order followed by mask columns.

    Each run becomes (column, since, until, value) entries. A stay's entries, at most
    steps x channels of them, are laid out by one vectorised Arrow kernel; the runs are
    already partitioned by stay, so no further shuffle takes place. A category outside
    the list is an error, or is left out with ``on_bad='null'``.
    """
    names = frame_columns(channels)
    place = {n: i for i, n in enumerate(names)}
    table = F.create_map(*[x for n, i in place.items() for x in (F.lit(n), F.lit(i))])
    at = lambda n: F.try_element_at(table, n)
    entry = lambda col, since, until, v: F.struct(
        col.alias("c"), since.alias("a"), until.alias("b"), v.cast("float").alias("v")
    )
    since, until = F.col("since"), F.col("until")
    bad = F.raise_error(F.concat(F.lit("category is not configured for "), F.col("variable"))).cast("int")
    code = lambda x: at(F.concat(F.col("variable"), F.lit("->"), x))
    hot = F.transform(
        "cats",
        lambda x: entry(F.coalesce(code(x), bad) if on_bad == "error" else code(x), since, until, F.lit(1.0)),
    )
    if on_bad != "error":
        hot = F.filter(hot, lambda e: e["c"].isNotNull())
    data = F.when(F.col("cats").isNull(), F.array(entry(at(F.col("variable")), since, until, F.col("num")))).otherwise(hot)
    seen = F.array(entry(at(F.concat(F.lit("mask->"), F.col("variable"))), F.col("bin"), F.col("bin") + 1, F.lit(1.0)))
    both = F.when(F.col("bin") >= 0, F.concat(data, seen)).otherwise(data)
    packed = runs.groupBy("stay_id").agg(
        F.max("until").alias("bins"), F.flatten(F.collect_list(both)).alias("e")
    )
    flat = packed.select(
        "stay_id", "bins", *[F.col(f"e.{k}").alias(k) for k in ("c", "a", "b", "v")]
    )
    return flat.mapInArrow(_lay_out(len(names)), "stay_id long, step int, x array<float>")


def _lay_out(width: int, stays_per_pass: int = 256):
    """Arrow kernel: runs of a few hundred stays at a time to dense step rows."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, stays_per_pass):
                part = batch.slice(start, stays_per_pass)
                bins = part.column("bins").to_numpy(zero_copy_only=False).astype(np.int64)
                base = np.concatenate([[0], np.cumsum(bins)])
                counts = np.diff(part.column("c").offsets.to_numpy())
                get = lambda k: part.column(k).flatten().to_numpy(zero_copy_only=False)
                since, until = get("a").astype(np.int64), get("b").astype(np.int64)
                size = until - since
                first = np.repeat(base[:-1], counts) + since
                total = int(size.sum())
                ahead = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
                rows = np.repeat(first - ahead, size) + np.arange(total)
                x = np.zeros((int(base[-1]), width), dtype=np.float32)
                x[rows, np.repeat(get("c"), size)] = np.repeat(get("v"), size)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column("stay_id").to_numpy(zero_copy_only=False), bins)),
                        pa.array((np.arange(len(x)) - np.repeat(base[:-1], bins)).astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(x.ravel())),
                    ],
                    names=["stay_id", "step", "x"],
                )

    return run


def channel_stats(runs: DataFrame, train: DataFrame) -> DataFrame:
    """Train mean and sample std per continuous channel over full-length frames.

    A run of n equal steps counts n times, so the frame is never expanded.
    """
    kept = runs.join(train.select("stay_id"), "stay_id", "left_semi")
    found = weighted_moments(kept.withColumn("_steps", F.col("until") - F.col("since")), ["variable"], "num", "_steps")
    std = F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0.0)))
    return found.select("variable", "mean", F.greatest(std, F.lit(STD_FLOOR)).alias("std"), F.col("n").cast("bigint").alias("rows"))


def normalise(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Z-score continuous channels; one row of statistics per channel is broadcast."""
    z = (F.col("num") - F.col("mean")) / F.col("std")
    return (
        long.join(F.broadcast(stats.select("variable", "mean", "std")), "variable", "left")
        .withColumn("num", F.when(F.col("std").isNotNull(), z).otherwise(F.col("num")))
        .drop("mean", "std")
    )


def padded(wide: DataFrame, stays: DataFrame, max_steps: int, width: int) -> DataFrame:
    """One row per (stay, step < max_steps): zeros and a false step mask where padded."""
    steps = stays.select("stay_id", F.explode(F.sequence(F.lit(0), F.lit(max_steps - 1))).alias("step"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    return steps.join(wide, ["stay_id", "step"], "left").select(
        "stay_id", "step", F.coalesce("x", zeros).alias("x"), F.col("x").isNotNull().alias("step_mask")
    )
