"""Structured Streaming twins of the event and note operators.

Every job gives the result of its batch counterpart on bounded input. State is keyed and
bounded by a watermark wherever late data can be dropped.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import bin_count, bin_id, hours_between
from ..operators import events as ev
from ..operators.frames import CATEGORICAL


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def attributed(stream: DataFrame, stays: DataFrame, items: DataFrame, keep_time: bool = False) -> DataFrame:
    """Clean arriving events and attribute them to stays by stream-static joins."""
    cleaned = ev.clean_events(ev.in_scope(stream, stays, items), items)
    if not keep_time:
        return ev.attribute(cleaned, stays)
    e = cleaned.withColumnRenamed("stay_id", "_event_stay")
    s = stays.select("subject_id", "stay_id", "intime", "outtime", "los_hours")
    hit = F.coalesce(F.col("_event_stay") == F.col("stay_id"), F.lit(False)) | F.col(
        "charttime"
    ).between(F.col("intime"), F.col("outtime"))
    joined = e.join(s, "subject_id").filter(hit).withColumn("hours", hours_between("charttime", "intime"))
    return ev.in_stay_hours(joined).select("stay_id", "variable", "charttime", "hours", "num", "txt")


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop exact replays of (stay, variable, time, value) inside the watermark."""
    return stream.withWatermark("charttime", delay).dropDuplicatesWithinWatermark(
        ["stay_id", "variable", "charttime", "txt"]
    )


def step_bins(stream: DataFrame, step: float = 1.0, delay: str = "1 day") -> DataFrame:
    """Admission-anchored bins: latest number, or the set of categories, per bin.

    The event-time hour joins the key so that finished bins leave the state.
    """
    is_text = F.col("variable").isin(CATEGORICAL)
    hour = F.window("charttime", f"{int(step * 3600)} seconds")
    keyed = stream.withWatermark("charttime", delay).withColumn("bin", bin_id(F.col("hours"), step))
    part = keyed.filter(F.col("bin") >= 0).groupBy(hour, "stay_id", "variable", "bin").agg(
        F.max(F.struct("hours", "num", "txt")).alias("last"),
        F.array_sort(F.collect_set(F.when(is_text, F.col("txt")))).alias("cats"),
    )
    # An admission-anchored bin touches two clock hours; the sink merges the two parts.
    return part.select("stay_id", "variable", "bin", "last", "cats", F.col("window.start").alias("clock"))


def merged_bins(parts: DataFrame) -> DataFrame:
    """Batch merge of the clock-hour parts written by ``step_bins``."""
    text = F.col("variable").isin(CATEGORICAL)
    return (
        parts.groupBy("stay_id", "variable", "bin")
        .agg(F.max("last").alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cats")))).alias("cats"))
        .select(
            "stay_id",
            "variable",
            "bin",
            F.when(~text, F.col("last.num")).alias("num"),
            F.when(text, F.col("cats")).alias("cats"),
        )
    )


def first_offsets(notes: DataFrame, stays: DataFrame) -> DataFrame:
    """Running earliest note offset per stay (update mode)."""
    from ..operators.notes import first_offsets as batch

    return batch(notes, stays)


def running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count, mean and sum of squared deviations per key (complete mode). The state holds
    central moments, which are merged pairwise, so large values do not cancel."""
    v = F.col(value).cast("double")
    return stream.filter(v.isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("m2")
    )


def moments_to_stats(moments: DataFrame, key: str, sample: bool) -> DataFrame:
    below = F.nullif(F.col("n") - 1, F.lit(0)) if sample else F.col("n")
    return moments.select(key, "mean", F.sqrt(F.col("m2") / below).alias("std"))


class CarryForward(StatefulProcessor):
    """Carried runs of a stay's channels, given out once the watermark has passed the stay's end.

    State is the latest value of each channel's observed bins, in event time, so rows may come in
    any order inside the watermark; it is bounded by the bins of a stay.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "variable array<string>, bin array<int>, hours array<double>, num array<double>")
        self.length = handle.getValueState("length", "bins int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest: dict[tuple[str, int], tuple[float, float]] = {}
        first = None
        for pdf in rows:
            first = pdf if first is None else first
            for v, b, h, n in zip(pdf["variable"].tolist(), pdf["bin"].tolist(), pdf["hours"].tolist(), pdf["num"].tolist()):
                if (v, b) not in latest or latest[v, b] < (h, n):
                    latest[v, b] = (h, n)
        if first is not None:
            if self.length.exists():
                for at, seen in self._seen():
                    latest[at] = max(latest.get(at, seen), seen)
            else:
                self.length.update((int(first["bins"].iloc[0]),))
                self.handle.registerTimer(int(first["ends_ms"].iloc[0]))
            # One state value a stay: a call to the state store costs more than the bins of a stay.
            self.seen.update(([v for v, _ in latest], [int(b) for _, b in latest], [h for h, _ in latest.values()], [n for _, n in latest.values()]))
        yield pd.DataFrame(columns=RUN_COLUMNS)

    def _seen(self) -> list[tuple]:
        variable, bins, hours, nums = self.seen.get()
        return list(zip(zip(variable, bins), zip(hours, nums)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = sorted((v, b, num) for (v, b), (_, num) in self._seen())
        length = self.length.get()[0]
        until = [b[1] if a[0] == b[0] else length for a, b in zip(runs, runs[1:])] + [length]
        out = [(key[0], variable, since, u, num) for (variable, since, num), u in zip(runs, until)]
        self.seen.clear()
        self.length.clear()
        yield pd.DataFrame(out, columns=RUN_COLUMNS)

    def close(self) -> None:
        pass


RUN_COLUMNS = ["stay_id", "variable", "since", "until", "num"]


def carried(attributed_stream: DataFrame, stays: DataFrame) -> DataFrame:
    """Runs [since, until) of carried values of continuous channels, as the batch frames have them;
    the last run of a stay ends with it. The input carries a watermark on charttime."""
    ends = stays.select(
        "stay_id",
        bin_count(F.col("los_hours")).alias("bins"),
        F.unix_millis(F.col("intime") + F.make_dt_interval(hours=bin_count(F.col("los_hours")))).alias("ends_ms"),
    )
    rows = attributed_stream.filter(~F.col("variable").isin(CATEGORICAL) & F.col("num").isNotNull()).join(ends, "stay_id")
    rows = rows.withColumn("bin", bin_id(F.col("hours"))).filter((F.col("bin") >= 0) & (F.col("bin") < F.col("bins")))
    return rows.groupBy("stay_id").transformWithStateInPandas(
        statefulProcessor=CarryForward(),
        outputStructType="stay_id long, variable string, since int, until int, num double",
        outputMode="Append",
        timeMode="EventTime",
    )


def run_to_table(
    stream: DataFrame, spark: SparkSession, mode: str = "append", label: str = "stream", closing=None
) -> DataFrame:
    """Drive a bounded stream to completion and read back what it wrote.

    The checkpoint and the output live in the shared checkpoint folder. ``closing`` is called when
    all input has been read, to add what moves the watermark on; the stream then goes on from its
    checkpoint.
    """
    from ..session import scratch_path

    out, mark = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    def drive() -> None:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", mark)
            .trigger(availableNow=True)
            .foreachBatch(put)
            .start()
        )
        query.awaitTermination()

    drive()
    if closing is not None:
        closing()
        drive()
    return spark.read.parquet(out)
