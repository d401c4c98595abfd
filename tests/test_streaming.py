"""Streams over several files in several batches give the batch result."""

from pyspark.sql import functions as F

from poolweave.operators import events as ev, frames, notes
from poolweave.plans.bindings import Tables
from poolweave.session import scratch_path
from poolweave.streaming import events as st

FOLDER = "/root/testdata/sf0.001"


def in_files(spark, df, order, parts=4):
    """Write in time order to several files, so that each becomes one micro-batch."""
    path = scratch_path(spark, "feed")
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(path)
    return path, spark.read.parquet(path).schema


def attributed(spark, t):
    path, schema = in_files(spark, t.raw_events.drop("event_id"), "charttime")
    return st.attributed(st.read_stream(spark, path, schema), t.ev_stays, t.items, keep_time=True)


def test_bins_over_batches_equal_batch(spark):
    t = Tables(spark, FOLDER)
    got = st.merged_bins(st.run_to_table(st.step_bins(attributed(spark, t), delay="40 days"), spark, "update"))
    want = frames.bin_values(t.stay_events, t.ev_stays, max_steps=None)
    cols = ["stay_id", "variable", "bin", "num", "cats"]
    inside = want.select(*cols)
    a = sorted(map(str, got.select(*cols).join(inside, ["stay_id", "variable", "bin"], "left_semi").collect()))
    assert a == sorted(map(str, inside.collect()))


def test_first_offsets_over_batches(spark):
    t = Tables(spark, FOLDER)
    path, schema = in_files(spark, t.raw_notes, "source_row")
    out = st.run_to_table(st.first_offsets(st.read_stream(spark, path, schema), t.note_stays), spark, "update")
    got = out.groupBy("stay_id").agg(F.min("first_note_hours").alias("h"))
    want = notes.first_offsets(t.raw_notes, t.note_stays)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_moments_over_batches(spark):
    t = Tables(spark, FOLDER)
    out = st.run_to_table(st.running_moments(attributed(spark, t), "variable", "num"), spark, "complete")
    last = out.agg(F.max("_batch")).first()[0]
    assert last >= 2
    got = {r["variable"]: r["n"] for r in out.filter(F.col("_batch") == last).collect()}
    clean = ev.attribute(t.clean, t.ev_stays).filter("num is not null")
    assert got == {r["variable"]: r["count"] for r in clean.groupBy("variable").count().collect()}


def test_replays_are_dropped(spark):
    t = Tables(spark, FOLDER)
    twice = t.raw_events.drop("event_id").unionByName(t.raw_events.drop("event_id"))
    path, schema = in_files(spark, twice, "charttime")
    stream = st.attributed(st.read_stream(spark, path, schema), t.ev_stays, t.items, keep_time=True)
    out = st.run_to_table(st.deduplicated(stream, "40 days"), spark)
    assert out.count() == ev.attribute(t.clean, t.ev_stays).select("stay_id", "variable", "hours", "txt").distinct().count()


def test_carry_forward_over_batches_equals_the_batch_frames(spark):
    from poolweave.plans import registry
    from tests import compare

    assert compare.check(spark, compare.connect(FOLDER), registry.load()["streamed_carry_forward"], FOLDER) == ""
    t = Tables(spark, FOLDER)
    got = registry.runner(registry.load()["streamed_carry_forward"])(spark, FOLDER).filter("variable = 'Heart Rate'")
    runs = frames.validity_runs(frames.bin_values(t.stay_events, t.ev_stays), t.ev_stays)
    want = runs.filter("variable = 'Heart Rate' and bin >= 0").select("stay_id", "since", "until")
    assert sorted(map(tuple, got.select("stay_id", "since", "until").collect())) == sorted(map(tuple, want.collect()))
