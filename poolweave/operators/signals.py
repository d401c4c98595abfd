"""Multi-lead signals in long form: gap repair, resampling, lead order, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import checks

# Lead names and their place in the packed signal.
LEADS = {
    "i": 0,
    "ii": 1,
    "v1": 2,
    "v2": 3,
    "v3": 4,
    "v4": 5,
    "v5": 6,
    "v6": 7,
    "iii": 8,
    "avr": 9,
    "avl": 10,
    "avf": 11,
}


def gap_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("study_id").agg(F.count_if(F.col("mv").isNull()).alias("gaps"))


# Samples of one lead that a single window may see.
CHUNK = 100_000


def repair(signals: DataFrame, clip: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """Fill gaps per (study, lead): linear inside, nearest value at the ends, 0 if the
    lead has no value at all; then clip.

    Windows run inside chunks of a recording. The nearest known sample beyond a chunk
    comes from a table with one row per chunk, so a very long recording stays spread out.
    """
    keys = ["study_id", "lead", "_c"]
    cut = signals.withColumn("_c", F.floor(F.col("t") / F.lit(chunk)))
    known = F.when(F.col("mv").isNotNull(), F.struct("t", "mv"))
    edges = cut.groupBy(*keys).agg(F.min(known).alias("_first"), F.max(known).alias("_last"))
    chunks = Window.partitionBy("study_id", "lead").orderBy("_c")
    edges = edges.select(
        *keys,
        F.last("_last", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(chunks.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy(*keys).orderBy("t")
    back = inside.rowsBetween(Window.unboundedPreceding, 0)
    fwd = inside.rowsBetween(0, Window.unboundedFollowing)
    w = cut.withColumn("_p", F.last(known, ignorenulls=True).over(back)).withColumn(
        "_n", F.first(known, ignorenulls=True).over(fwd)
    )
    w = w.join(edges, keys).withColumn("_p", F.coalesce("_p", "_before")).withColumn("_n", F.coalesce("_n", "_after"))
    share = (F.col("t") - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t")).cast("double")
    between = F.col("_p.mv") + share * (F.col("_n.mv") - F.col("_p.mv"))
    value = (
        F.when(F.col("mv").isNotNull(), F.col("mv"))
        .when(F.col("_p").isNull() & F.col("_n").isNull(), F.lit(0.0))
        .when(F.col("_p").isNull(), F.col("_n.mv"))
        .when(F.col("_n").isNull(), F.col("_p.mv"))
        .otherwise(between)
    )
    if clip > 0:
        value = F.greatest(F.least(value, F.lit(float(clip))), F.lit(-float(clip)))
    return w.select("study_id", "lead", "t", value.alias("mv"), F.col("mv").isNull().alias("repaired"))


def resample(signals: DataFrame, source_hz: float, target_hz: float, samples: int | None = None) -> DataFrame:
    """Down: the mean of each target-rate time bucket. Up: linear interpolation between
    neighbouring samples at every target time. Cut to ``samples`` if the caller names a number."""
    checks.require(source_hz > 0 and target_hz > 0, "sampling rates are above 0")
    if target_hz > source_hz:
        out = _interpolated(signals, float(target_hz) / float(source_hz))
    else:
        bucket = F.floor(F.col("t") * F.lit(float(target_hz)) / F.lit(float(source_hz))).cast("int")
        out = signals.groupBy("study_id", "lead", bucket.alias("t")).agg(F.avg("mv").alias("mv"))
    return out if samples is None else out.filter(F.col("t") < samples)


def _interpolated(signals: DataFrame, ratio: float, chunk: int = CHUNK) -> DataFrame:
    """Each sample gives the target times from its own up to the next sample's. Windows run inside
    chunks of a recording, as in ``repair``; a chunk's last sample looks up the next chunk's first."""
    keys = ["study_id", "lead", "_c"]
    cut = signals.select("study_id", "lead", "t", "mv", F.floor(F.col("t") / F.lit(chunk)).alias("_c"))
    sample = F.struct("t", "mv")
    firsts = cut.groupBy(*keys).agg(F.min(sample).alias("_first"))
    ahead = F.lead("_first").over(Window.partitionBy("study_id", "lead").orderBy("_c"))
    firsts = firsts.select(*keys, ahead.alias("_after"))
    inside = Window.partitionBy(*keys).orderBy("t")
    w = cut.withColumn("_own", F.lead(sample).over(inside)).join(firsts, keys)
    w = w.withColumn("_next", F.coalesce("_own", "_after"))
    start = F.ceil(F.col("t") * ratio)
    stop = F.coalesce(F.ceil(F.col("_next.t") * ratio) - 1, F.floor(F.col("t") * ratio))
    times = F.when(start <= stop, F.sequence(start, stop))
    w = w.select("study_id", "lead", F.col("t").alias("_t"), F.col("mv").alias("_mv"), "_next", F.explode(times).alias("_k"))
    share = (F.col("_k") / F.lit(ratio) - F.col("_t")) / (F.col("_next.t") - F.col("_t"))
    value = F.coalesce(F.col("_mv") + share * (F.col("_next.mv") - F.col("_mv")), F.col("_mv"))
    return w.select("study_id", "lead", F.col("_k").cast("int").alias("t"), value.alias("mv"))


def lead_order(signals: DataFrame, leads: dict[str, int] = LEADS) -> DataFrame:
    """Lead name to its fixed index; unknown leads are dropped."""
    table = F.create_map(*[x for k, v in leads.items() for x in (F.lit(k), F.lit(v))])
    return signals.withColumn("lead_index", F.try_element_at(table, F.lower("lead"))).filter(
        F.col("lead_index").isNotNull()
    )


def packed(signals: DataFrame, samples: int | None = None, leads: dict[str, int] = LEADS) -> DataFrame:
    """One row per (study, lead index) with a zero-padded array; absent leads are zeros. A study's
    arrays are as long as its own longest lead, or ``samples`` values, where that is given."""
    ordered = lead_order(signals, leads).filter(F.col("t") >= 0)
    kept = ordered if samples is None else ordered.filter(F.col("t") < samples)
    per_lead = kept.groupBy("study_id", "lead_index").agg(
        F.collect_list("t").alias("at"), F.collect_list(F.coalesce("mv", F.lit(0.0))).alias("v")
    )
    if samples is None:
        lengths = signals.groupBy("study_id").agg(F.lit(0).alias("_none")).join(ordered.groupBy("study_id").agg((F.max("t") + 1).alias("_longest")), "study_id", "left")
        studies = lengths.select("study_id", F.coalesce("_longest", F.lit(0)).cast("long").alias("samples"))
    else:
        studies = signals.select("study_id").distinct().withColumn("samples", F.lit(samples).cast("long"))
    grid = studies.withColumn("lead_index", F.explode(F.array(*[F.lit(i) for i in sorted(set(leads.values()))])))
    schema = T.StructType([signals.schema["study_id"], *T.StructType.fromDDL("lead_index int, mv array<float>").fields])
    return grid.join(per_lead, ["study_id", "lead_index"], "left").mapInArrow(_dense, schema)


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(time, value) lists to arrays of as many values as each row asks for, some rows at a time."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):
            batch = whole.slice(i, 1024)
            ends = np.cumsum(batch.column("samples").to_numpy())
            firsts = ends - batch.column("samples").to_numpy()
            out = np.zeros(int(ends[-1]) if len(ends) else 0, np.float32)
            counts = pa.compute.fill_null(pa.compute.list_value_length(batch.column("at")), 0).to_numpy()
            places = batch.column("at").flatten().to_numpy(zero_copy_only=False)
            out[np.repeat(firsts, counts) + places] = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            values = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([batch.column("study_id"), batch.column("lead_index"), values], ["study_id", "lead_index", "mv"])


def lead_stats(signals: DataFrame) -> DataFrame:
    """Corpus mean and population std per lead."""
    return signals.groupBy("lead").agg(F.avg("mv").alias("mean"), F.stddev_pop("mv").alias("std"))


def record_stats(signals: DataFrame) -> DataFrame:
    """Mean over records of each record's own mean and std, per lead."""
    per = signals.groupBy("study_id", "lead").agg(
        F.avg("mv").alias("m"), F.stddev_pop("mv").alias("s")
    )
    return per.groupBy("lead").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


def first_record(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested studies only; the first path wins, sorted by study."""
    return (
        index.join(wanted.select("study_id").distinct(), "study_id", "left_semi")
        .groupBy("study_id")
        .agg(F.min_by(F.struct("subject_id", "path"), "source_row").alias("r"))
        .select("study_id", "r.subject_id", "r.path")
        .orderBy("study_id")
    )


def missing_records(wanted: DataFrame, records: DataFrame) -> DataFrame:
    return wanted.select("study_id").distinct().join(records.select("study_id"), "study_id", "left_anti")


def record_findings(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Studies with several records, and rows without one."""
    lost = missing_records(rows, records).agg(F.count("*").alias("violations"))
    return checks.duplicate_count(records, ["study_id"], "study with several records").unionByName(
        lost.select(F.lit("study without record").alias("check"), "violations")
    )


def with_signal(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Tabular row joined with its packed signal by study."""
    return rows.join(signals, "study_id")


def interval_overlaps(index: DataFrame) -> DataFrame:
    """Records of a file whose range starts before an earlier record has ended.

    Files are cut into chunks of ``start`` first, so one large file does not become one
    task: inside a chunk the running end is a window, across chunks it is a window over
    one row per chunk.
    """
    from ..functions.ranks import range_bounds, range_of

    ends = index.withColumn("end", F.col("start") + F.col("length"))
    ends = ends.withColumn(
        "_c", range_of(F.col("start").cast("double"), range_bounds(ends, "start"))
    )
    chunk = ends.groupBy("file_id", "_c").agg(F.max("end").alias("_e"))
    ahead = Window.partitionBy("file_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.select("file_id", "_c", F.max("_e").over(ahead).alias("_ahead"))
    inside = (
        Window.partitionBy("file_id", "_c")
        .orderBy("start", "record_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ends.join(chunk, ["file_id", "_c"])
        .withColumn("busy_until", F.greatest(F.max("end").over(inside), F.col("_ahead")))
        .filter(F.col("start") < F.col("busy_until"))
        .select("file_id", "record_id", "start", "busy_until")
    )


def index_findings(index: DataFrame, files: DataFrame, length: int) -> DataFrame:
    """Ranges inside their file, exact lengths, no overlap, ids a full range [0, N)."""
    joined = index.join(files, "file_id", "left")
    rows = checks.count_findings(
        joined,
        {
            "unknown file": F.col("file_length").isNull(),
            "negative start": F.col("start") < 0,
            "wrong length": F.col("length") != length,
            "range beyond file": F.col("file_length").isNotNull()
            & (F.col("start") + F.col("length") > F.col("file_length")),
        },
    )
    overlap = interval_overlaps(index).agg(F.count("*").alias("violations"))
    return checks.union_all(
        [
            rows,
            overlap.select(F.lit("overlapping ranges").alias("check"), "violations"),
            full_range_findings(index, "record_id"),
        ]
    )


def full_range_findings(df: DataFrame, column: str) -> DataFrame:
    """0 when the column is a permutation of 0..N-1, else 1."""
    row = df.groupBy(column).agg(F.count("*").alias("_k")).agg(
        F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("d"), F.sum("_k").alias("n")
    )
    good = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))
    return row.select(
        F.lit("ids are not a full range").alias("check"),
        F.when(good | F.col("n").isNull(), 0).otherwise(1).cast("bigint").alias("violations"),
    )
