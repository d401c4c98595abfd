"""Cleaner tables and frame semantics by hand-worked values."""

import pytest
from pyspark.sql import functions as F

from poolweave.functions import columns as C
from poolweave.operators import events as ev, frames

def one(spark, column, value, uom=None, label=None):
    return spark.createDataFrame([(value, uom, label)], "v string, u string, l string").select(column).first()[0]


@pytest.mark.parametrize(
    "cleaner,inputs,args,want",
    [
        ("systolic", 1, ("120/80",), 120.0),
        ("diastolic", 1, ("120/80",), 80.0),
        ("systolic", 1, ("130",), 130.0),
        ("systolic", 1, ("garbage",), None),
        ("capillary_refill", 1, ("Brisk",), 0.0),
        ("capillary_refill", 1, ("Normal <3 secs",), 0.0),
        ("capillary_refill", 1, ("Delayed",), 1.0),
        ("capillary_refill", 1, ("Abnormal >3 secs",), 1.0),
        ("capillary_refill", 1, ("Other",), None),
        ("oxygen_fraction", 2, ("40", "%"), 0.4),
        ("oxygen_fraction", 2, ("0.4", "%"), 0.4),
        ("oxygen_fraction", 2, ("40", "torr"), 40.0),
        ("temperature", 3, ("98.6", "F"), 37.0),
        ("temperature", 3, ("37.0", "C"), 37.0),
        ("temperature", 3, ("85.0", "C"), (85 - 32) * 5 / 9),
        ("weight", 3, ("160", "lb"), 160 * 0.453592),
        ("weight", 3, ("32", "oz"), 32 / 16 * 0.453592),
        ("height", 3, ("70", "in"), 178.0),
        ("oxygen_saturation", 1, ("0.97",), 97.0),
        ("oxygen_saturation", 1, ("97",), 97.0),
        ("oxygen_saturation", 1, ("ERROR",), None),
        ("lab_value", 1, ("128",), 128.0),
        ("lab_value", 1, ("1.0f",), None),
        ("lab_value", 1, ("12d",), None),
    ],
)
def test_cleaners(spark, cleaner, inputs, args, want):
    columns = [F.col(c) for c in ("v", "u", "l")][:inputs]
    got = one(spark, getattr(ev, cleaner)(*columns), *args)
    assert got == (pytest.approx(want) if want is not None else None)


def stay(spark, los):
    return spark.createDataFrame([(1, float(los))], "stay_id long, los_hours double")


def long_events(spark, rows):
    return spark.createDataFrame([(1, c, float(h), n, x) for c, h, n, x in rows], "stay_id long, variable string, hours double, num double, txt string")


def wide(spark, rows, los, **options):
    e, s = long_events(spark, rows), stay(spark, los)
    binned = frames.bin_values(e, s, **options)
    runs = frames.validity_runs(binned, s, max_steps=options.get("max_steps"))
    out = frames.frames_wide(runs).orderBy("step").collect()
    names = frames.frame_columns()
    return {n: [r["x"][i] for r in out] for i, n in enumerate(names)}


def test_layout():
    names = frames.frame_columns()
    assert len(names) == 76 and sum(n.startswith("mask->") for n in names) == 17
    assert sum("->" not in n for n in names) == 12


@pytest.mark.parametrize("hours,bins", [(47.5, 48), (24.0, 24)])
def test_bin_count(spark, hours, bins):
    assert spark.range(1).select(C.bin_count(F.lit(hours))).first()[0] == bins


def test_last_in_bin_and_carry_forward(spark):
    x = wide(spark, [("Heart Rate", 0.5, 80.0, "80"), ("Heart Rate", 0.9, 90.0, "90"), ("Heart Rate", 2.3, 70.0, "70")], 5)
    assert x["Heart Rate"] == [90, 90, 70, 70, 70]
    assert x["mask->Heart Rate"] == [1, 0, 1, 0, 0]


def test_default_before_the_first_value(spark):
    x = wide(spark, [("Glucose", 1.5, 200.0, "200")], 3)
    assert x["Glucose"] == [128, 200, 200]
    assert x["Glascow coma scale total->15"] == [1, 1, 1]
    assert x["pH"][0] == pytest.approx(7.4)


def test_two_categories_in_a_bin_are_both_set_unless_latest_is_asked(spark):
    rows = [("Glascow coma scale total", 0.2, 15.0, "15"), ("Glascow coma scale total", 0.8, 3.0, "3")]
    x = wide(spark, rows, 2)
    assert x["Glascow coma scale total->15"] == [1, 1] and x["Glascow coma scale total->3"] == [1, 1]
    y = wide(spark, rows, 2, mode="latest")
    assert y["Glascow coma scale total->15"] == [0, 0] and y["Glascow coma scale total->3"] == [1, 1]


def test_step_cap_and_first_hour(spark):
    x = wide(spark, [("Glucose", 1.0, 99.0, "99"), ("Glucose", 40.0, 10.0, "10")], 48, max_steps=8)
    assert len(x["Glucose"]) == 8 and x["Glucose"][0] == 99 and x["Glucose"][-1] == 99


def test_unknown_category_is_an_error_or_left_out(spark):
    e, s = long_events(spark, [("Glascow coma scale total", 0.2, None, "odd")]), stay(spark, 1)
    runs = frames.validity_runs(frames.bin_values(e, s), s)
    with pytest.raises(Exception, match="not configured"):
        frames.frames_wide(runs).collect()
    assert frames.frames_wide(runs, on_bad="null").count() == 1
    found = {r["check"]: r["violations"] for r in frames.channel_findings(e).collect()}
    assert found["unknown category"] == 1


def test_largest_value_per_time(spark):
    rows = [("Glucose", 1.0, 9.0, "9.0"), ("Glucose", 1.0, 10.0, "10.0"), ("Glascow coma scale total", 1.0, 9.0, "9"), ("Glascow coma scale total", 1.0, 10.0, "10")]
    out = {r["variable"]: r["txt"] for r in ev.largest_per_time(long_events(spark, rows), frames.CATEGORIES).collect()}
    assert out == {"Glucose": "10.0", "Glascow coma scale total": "10"}


def test_normaliser_is_centered_on_train(spark):
    import numpy as np

    e = long_events(spark, [("Heart Rate", 0.5, 80.0, "80"), ("Heart Rate", 2.3, 70.0, "70")])
    s = stay(spark, 5)
    runs = frames.validity_runs(frames.bin_values(e, s), s)
    z = frames.normalise(frames.frames_long(runs), frames.channel_stats(runs, s)).filter("variable = 'Heart Rate'").toPandas()["num"]
    assert np.isclose(z.mean(), 0) and np.isclose(z.std(ddof=1), 1)


def test_event_inside_two_stays_counts_for_both(spark):
    stays = spark.sql(
        "select 5L as subject_id, id as stay_id, timestamp '2024-01-01 00:00:00' as intime, timestamp '2024-01-02 00:00:00' as outtime, 24.0D as los_hours from range(2)"
    )
    e = spark.sql(
        "select 5L as subject_id, cast(null as long) as stay_id, timestamp '2024-01-01 06:00:00' as charttime, 'Glucose' as variable, 1.0D as num, '1' as txt"
    )
    assert [r["hours"] for r in ev.attribute(e, stays).collect()] == [6.0, 6.0]


def test_note_cleaning(spark):
    text = "  Admission Date: [**2101**]\n1. Dr. Smith, M.D. -- seen\r"
    got = spark.createDataFrame([(text,)], "t string").select(C.clean_note(F.col("t"))).first()[0]
    assert got == "   doctor smith, md  seen"
