"""Streaming jobs over the shared event and note tables, driven to completion."""

from __future__ import annotations

from pyspark.sql import functions as F
from ..functions.scalars import with_scalars

from ..session import scratch_path
from ..streaming import events as st
from .bindings import views
from .dialect import Spark
from .oracle_views import R
from .registry import query

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Streamed(Spark):
    """Spark spelling in which one table is a stream instead of a file."""

    def __init__(self, spark, folder: str, table: str, view: str):
        super().__init__(spark, folder)
        self.table, self.stream_view = table, view

    def t(self, name: str) -> str:
        return self.stream_view if name == self.table else super().t(name)


FILES = 4


def _feed(t, table: str, files: int = FILES) -> str:
    """The table in several files, each with rows of all times; every file is a micro-batch."""
    path = scratch_path(t.spark, f"feed-{table}")
    rows = t.raw(table)
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(path)
    return path


def _stream(t, table: str, view: str, feed: str | None = None):
    """The rows of ``view`` with ``table`` read as a stream of files."""
    source = st.read_stream(t.spark, feed or _feed(t, table), t.raw(table).schema)
    name = f"_poolweave_stream_{table}"
    source.createOrReplaceTempView(name)
    return t.spark.sql(views(_Streamed(t.spark, t.folder, table, name))[view])


def _delay(t) -> str:
    """Files hold rows of all times, so a row may be as late as the data are long."""
    row = t.raw_events.agg((F.unix_seconds(F.max("charttime")) - F.unix_seconds(F.min("charttime"))).alias("s")).first()
    return f"{(row.s or 0) + 3600} seconds"


def _attributed(t):
    return st.attributed(_stream(t, "events", "raw_events"), t.ev_stays, t.items, keep_time=True)


@query("streamed_attribution", "S1", f"select stay_id, variable, {R('hours')} as hours, {R('num')} as num from attributed")
def _(t):
    return st.run_to_table(_attributed(t), t.spark).select("stay_id", "variable", "hours", "num")


@query("streamed_bins", "S2", f"select stay_id, variable, cast(trunc(hours - 1e-6) as int) as bin, {R("case when variable <> 'Glascow coma scale total' then arg_max(num, hours) end")} as num from attributed where trunc(hours - 1e-6) >= 0 group by 1, 2, 3")
def _(t):
    parts = st.run_to_table(st.step_bins(_attributed(t), delay=_delay(t)), t.spark, "update")
    return st.merged_bins(parts).select("stay_id", "variable", "bin", "num")


@query("streamed_first_note", "S3", f"select stay_id, {R('first_note_hours')} as first_note_hours from note_offsets")
def _(t):
    notes = _stream(t, "conversations", "raw_notes")
    out = st.run_to_table(st.first_offsets(notes, t.note_stays), t.spark, "update")
    return out.groupBy("stay_id").agg(F.min("first_note_hours").alias("first_note_hours"))


@query("streamed_carry_forward", "S4", f"""
    with e as (select a.stay_id, variable, cast(trunc(hours - 1e-6) as int) as bin, num, hours, cast(trunc(los_hours + 1.0::double - 1e-6) as int) as bins
               from attributed a join ev_stays s on a.stay_id = s.stay_id where variable not like 'Glascow%' and variable <> 'Capillary refill rate' and num is not null),
    b as (select stay_id, variable, bin, bins, arg_max(num, {{'h': hours, 'n': num}}) as num from e where bin >= 0 and bin < bins group by 1, 2, 3, 4)
    select stay_id, variable, bin as since, coalesce(lead(bin) over (partition by stay_id, variable order by bin), bins) as until, {R('num')} as num from b""")
def _(t):
    feed = _feed(t, "events", 2)
    stream = _stream(t, "events", "raw_events", feed).withWatermark("charttime", _delay(t))
    runs = st.carried(st.attributed(stream, t.ev_stays, t.items, keep_time=True), t.ev_stays)

    def closing():
        # One event long after all stays: it belongs to none of them and only moves the watermark.
        late = t.raw("events").limit(1).withColumn("ts", (F.col("ts") + F.expr("interval 200 years")).cast(t.raw("events").schema["ts"].dataType))
        late.write.mode("append").parquet(feed)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    try:
        t.spark.conf.set(provider, ROCKS)
        return st.run_to_table(runs, t.spark, closing=closing).select(*st.RUN_COLUMNS)
    finally:
        t.spark.conf.set(provider, before)


@query("streamed_replay_removal", "S5", f"select distinct stay_id, variable, {R('hours')} as hours, {R('num')} as num from attributed")
def _(t):
    return st.run_to_table(st.deduplicated(_attributed(t), _delay(t)), t.spark).select("stay_id", "variable", "hours", "num")


@query("streamed_moments", "S6", f"select variable, {R('avg(num)')} as mean, {R('stddev_samp(num)')} as std from attributed where num is not null group by variable")
def _(t):
    out = st.run_to_table(st.running_moments(_attributed(t), "variable", "num"), t.spark, "complete")
    last = out.agg(F.max("_batch").alias("_m"))
    rows = with_scalars(out, last).filter(F.col("_batch") == F.col("_m"))
    return st.moments_to_stats(rows, "variable", sample=True)
